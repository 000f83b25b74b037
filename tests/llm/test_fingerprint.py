import hashlib
from functools import reduce

from pyspark.sql import functions as F
from threadloom.llm import fingerprint as fp
from xxhash import xxh64_intdigest


def brute_shingles(text, k=5):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxh64_intdigest(w.encode(), 42)) for w in text.split(" ") if w]
    step = lambda z, x: xxh64_intdigest((x % 2**64).to_bytes(8, "little"), z % 2**64)
    if len(h) < k:  # fewer words are one shingle
        return {signed(reduce(lambda z, x: step(step(42, z), x), h, 42))} if h else set()
    return {signed(reduce(step, h[i : i + k], 42)) for i in range(len(h) - k + 1)}


BELOW = -(2**63) + 2**64 // fp.SCALE


def brute_sketch(shingles):
    s = sorted(shingles)
    return s[: max(fp.LEAST, sum(x < BELOW for x in s))]


def brute_containment(a, b):
    if not a and not b:
        return 1.0
    whole = lambda s: 2**63 if len(s) < fp.LEAST else max(BELOW - 1, s[-1])
    t = min(whole(a), whole(b))
    x, y = {h for h in a if h <= t}, {h for h in b if h <= t}
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


TEXTS = ["", " ".join(f"w{i % 70}x{i}" for i in range(4000)), "a b c", "a b c d e", " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(300)), "a b c d e " * 9]


def test_sketch_and_codec(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", fp.sketch(F.col("t")).alias("s"), fp.decode(fp.encode(fp.sketch(F.col("t")))).alias("back")).collect()
    for r in rows:
        assert r["s"] == r["back"] == brute_sketch(brute_shingles(r["t"]))


def test_merged_sketches_are_the_union_s(spark):
    pairs = [(a, b) for a in TEXTS for b in TEXTS] + [("a b c d e", " ".join(f"v{k}_{i}" for i in range(204))) for k in range(40)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    a, b = fp.sketch(F.col("a")), fp.sketch(F.col("b"))
    for r in rows.select("a", "b", fp.merge(a, b).alias("m"), fp.containment(a, b).alias("c")).collect():
        x, y = brute_shingles(r["a"]), brute_shingles(r["b"])
        assert r["m"] == brute_sketch(x | y) and r["c"] == brute_containment(brute_sketch(x), brute_sketch(y))


def test_containment_estimates(spark):
    """A part of a text is contained in it, and half of one by half, within what the sketch's size allows."""
    whole = [f"w{i}" for i in range(6000)]
    rows = [(" ".join(whole), " ".join(whole[1000:3000]), 1.0), (" ".join(whole), " ".join(whole[3000:] + [f"v{i}" for i in range(3000)]), 0.5)]
    for r in spark.createDataFrame(rows, "a string, b string, want double").withColumn("c", fp.containment(fp.sketch(F.col("a")), fp.sketch(F.col("b")))).collect():
        assert abs(r["c"] - r["want"]) < 0.1


def test_query_against_brute_force(spark, tmp_path):
    texts = {5: "é" * 11, 1: None, 7: " ".join(f"a{i}" for i in range(300)), 9: " ".join(f"b{i}" for i in range(100)), 30: " ".join(f"a{i}" for i in range(300)), -4: "z", 40: "a b " * 40_000}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fp.query(spark, str(tmp_path)).collect()}
    ids = sorted(texts)
    code = lambda s: "".join(f"{x % 2**64:016X}" for x in s)
    for i, d in enumerate(ids):
        t, nxt = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(t)
        own, new, after = (brute_sketch(brute_shingles(x)) for x in (t, edited, nxt))
        assert got[d]["fingerprint"] == code(own) and got[d]["edited_fingerprint"] == code(new)
        assert got[d]["near_edited"] == brute_containment(own, new) and got[d]["near_next"] == brute_containment(own, after)
    assert got[7]["fingerprint"] == got[30]["fingerprint"] and 0.2 < got[7]["near_edited"] < 0.9 and got[7]["near_next"] == 0


def test_next_over_many_ranges(spark):
    ids = [3 * i for i in range(500)]
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "k bigint, v string")
    got = {r["k"]: r["nv"] for r in fp.with_next(rows, "k", {"v": "nv"}, 16).collect()}
    assert got == {i: str(ids[(n + 1) % len(ids)]) for n, i in enumerate(ids)}
    assert fp.with_next(rows.limit(0), "k", {"v": "nv"}).count() == 0
    assert fp.with_next(spark.createDataFrame([(None, "n"), (4, "f"), (4, "f")], "k bigint, v string"), "k", {"v": "nv"}).count() == 3
