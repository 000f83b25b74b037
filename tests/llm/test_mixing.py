from collections import defaultdict

from threadloom.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size int"


def data():
    out = [(i, "w " * (i % 90), f"s{i % 3 if i % 2 else 0}", 1) for i in range(1500)]
    return out + [(9000 + i, "tiny words here", "zz", 1) for i in range(3)] + [(9100, "null source text", None, 1)] * 2 + [(None, None, "s1", 1)]


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while True:
        left, w = total - sum(out.values()), sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * left / w > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * left / w for s in free}
        out |= {s: 3 * sizes[s] for s in over}
        free -= over


def test_targets_and_limits(spark):
    rows = data()
    got = mixing.mix_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = targets(sizes)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 16), (s, taken[s], want[s])
    again = mixing.mix_documents(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    key = lambda r: (r["doc_id"] or -1, r["taken"], r["size"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_texts_have_the_taken_words(spark):
    docs = spark.createDataFrame([r[:3] for r in data()], "doc_id bigint, text string, source string")
    out = mixing.stage(spark, docs, "").collect()
    want = sum(r["taken"] for r in mixing.mix_documents(docs).collect())
    assert sum(len(r["text"].split()) for r in out) == want


def test_blocks_are_spread():
    """Each prime permutes any number of blocks, and seeds of many shards don't all take runs of neighbours."""
    strides = set()
    for p in mixing.PRIMES:
        for m in (1, 7, 512, 1024, 60_000):
            assert len({j * p % m for j in range(m)}) == m
        strides.add(min(p % 1024, 1024 - p % 1024))
    assert len(mixing.PRIMES) == 16 and len(strides) >= 14 and 1 not in strides


def test_highest_quotients(spark):
    votes = [53.0, 24.0, 23.0, 0.0, 7.5, 1.2]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(votes)], "k int, v double")
    for n in (0, 1, 7, 40, 109):
        from pyspark.sql import functions as F

        got = {r["k"]: r["s"] for r in mixing.webster(rows, [], ["k"], "v", F.lit(n), "s").collect()}
        seats = [0] * len(votes)
        for _ in range(n):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
            seats[best] += 1
        assert [got[i] for i in range(len(votes))] == seats


def test_nothing_to_take(spark):
    assert mixing.mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["taken"] for r in mixing.mix_documents(spark.createDataFrame([(1, " ", "a", 0), (2, None, None, 0)], SCHEMA)).collect()] == [0, 0]
