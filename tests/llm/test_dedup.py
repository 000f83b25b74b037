import random

from threadloom.llm import dedup


def brute(data):
    sets = {}
    for i, t in data:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w)
    of = {i: i for i in sets}

    def find(a):
        while of[a] != a:
            a = of[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                of[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_against_brute_force(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(3000)}"
    base = [word() for _ in range(120)]
    data = []
    for i in range(150):  # edited copies, from light to beyond the limit, around one text
        w = list(base)
        for _ in range(r.randrange(14)):
            w[r.randrange(len(w))] = word()
        data.append((i, " ".join(w)))
    for i in range(150, 250):  # chains: each edits the one before
        w = data[-1][1].split()
        w[r.randrange(len(w))] = word()
        data.append((i, " ".join(w) if i % 20 else " ".join(word() for _ in range(60))))
    data += [(300 + i, "Same  TEXT\there") for i in range(20)] + [(400, ""), (401, None), (402, " \n"), (403, "one"), (404, "ONE"), (405, "w0 " * 9000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert got == brute(data)


def shared_passage(n_alone, clusters, size):
    """Texts that share a passage (similarity about 0.4): some alone, others edited copies of one another."""
    r = random.Random(11)
    words = lambda n: [f"v{r.randrange(100_000)}" for _ in range(n)]
    passage = words(90)
    texts = [passage + words(70) for _ in range(n_alone)]
    for own in (words(70) for _ in range(clusters)):
        for _ in range(size):
            w = passage + own
            for _ in range(r.randrange(12)):
                w[r.randrange(len(w))] = words(1)[0]
            texts.append(w)
    r.shuffle(texts)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def test_members_far_from_their_hub(spark):
    data = shared_passage(90, 5, 26)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert got == brute(data)


def test_odd_rows(spark):
    rows = dedup.near_duplicates(spark.createDataFrame([(None, "a b c", 1), (None, "a b c", 1), (5, "a b c", 1), (5, "a b c", 1), (7, "A b c", 1)], "doc_id bigint, text string, n_shingles int")).collect()
    assert len(rows) == 5 and {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} == {(None, None, True), (5, 5, True), (7, 5, False)}
    assert dedup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (50, 50)]
    got = {r["doc"]: r["component"] for r in dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def test_odd_sketch_estimates():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(1))
    common, own = rng.integers(0, 2**63, 800, np.uint64), rng.integers(0, 2**63, 200, np.uint64)
    a, b = dedup.min_hashes(np.concatenate([common, own[:100]])), dedup.min_hashes(np.concatenate([common, own[100:]]))
    bits = sum(int(x).bit_count() for x in (dedup.odd_sketch(a) ^ dedup.odd_sketch(b)).view(np.uint64))
    assert abs(1 + dedup.BITS / (4 * dedup.SAMPLES) * np.log(1 - 2 * bits / dedup.BITS) - 0.8) < 0.15
