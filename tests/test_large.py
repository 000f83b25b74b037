"""What larger tables brought up."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from threadloom.kernels import louvain
from threadloom.operators import graph


def louvain_by_the_book(edges):
    """Every node is looked at in every sweep."""
    near: dict = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    of, loops = {v: v for v in near}, {}
    while True:
        degree = {v: sum(n.values()) + 2 * loops.get(v, 0) for v, n in near.items()}
        com, weight, two_m, ever, moved = {v: v for v in near}, dict(degree), sum(degree.values()), False, True
        while moved:
            moved = False
            for v in sorted(near):
                links: dict = {}
                for u, w in near[v].items():
                    links[com[u]] = links.get(com[u], 0) + w
                weight[com[v]] -= degree[v]
                best, most = com[v], links.get(com[v], 0) - weight[com[v]] * degree[v] / two_m
                for c in sorted(links):
                    if links[c] - weight[c] * degree[v] / two_m > most + 1e-12:
                        best, most = c, links[c] - weight[c] * degree[v] / two_m
                moved, ever = moved or best != com[v], ever or best != com[v]
                weight[best] += degree[v]
                com[v] = best
        of = {v: com[c] for v, c in of.items()}
        if not ever:
            first: dict = {}
            return {v: first.setdefault(of[v], len(first)) for v in sorted(of)}
        above: dict = {c: {} for c in set(com.values())}
        inner: dict = {}
        for v, n in near.items():
            inner[com[v]] = inner.get(com[v], 0) + loops.get(v, 0) + sum(w for u, w in n.items() if com[u] == com[v]) / 2
            for u, w in n.items():
                if com[u] != com[v]:
                    above[com[v]][com[u]] = above[com[v]].get(com[u], 0) + w
        near, loops = above, inner


@pytest.mark.parametrize("many", [4, 200])
def test_louvain_looks_again_wherever_a_node_could_move(monkeypatch, many):
    monkeypatch.setattr(louvain, "MANY", many)
    r = np.random.default_rng(3)
    for n, m in ((40, 60), (300, 330), (600, 2400)):
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        edges = {(min(x, y), max(x, y)): float(w) for x, y, w in zip(a.tolist(), b.tolist(), r.integers(1, 4, m), strict=True) if x != y}
        rows = [(x, y, w) for (x, y), w in edges.items()]
        assert louvain.louvain(rows) == louvain_by_the_book(rows)


def test_graph_rounds_make_no_edges_again(spark):
    """Edges are made once, not in every round."""
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda a: made.add(1) or a, "bigint").asNondeterministic()
    people = spark.range(12).select(F.col("id").alias("user_id"))
    pairs = spark.range(11).select(count("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1).cast("bigint").alias("weight"))
    assert {r["component"] for r in graph.components(people, pairs).collect()} == {0}
    assert made.value <= 22
    graph.label_propagation(people, pairs)
    assert made.value <= 44


def test_rounding_is_that_of_the_sql(spark):
    """Halfway values: the product by a million decides."""
    import duckdb
    from threadloom.plans import registry

    rows = [(n, c / n) for n in range(1, 3300) for c in (1, 33)] + [(4480, 4487 / 4480)] + [(k, (k * 37 % 401 - 200) / 3200 + 0.07 * (k % 8)) for k in range(3000)]
    df = spark.createDataFrame(rows, "n bigint, x double")
    registry.query("_rounded", "SELECT 1", "x")(lambda spark, d: df)
    try:
        got = sorted((r["n"], r["x"]) for r in registry.QUERIES["_rounded"](spark, "").collect())
    finally:
        del registry.QUERIES["_rounded"], registry.SQL["_rounded"]
    with duckdb.connect() as sql:
        frame = df.toPandas()  # noqa: F841
        assert got == sorted(sql.sql("SELECT n, round(x, 6) + 0.0 FROM frame").fetchall())


def test_density_clusters_of_many_points(spark):
    """More points than one task was allowed, searched in tasks; the tree is the least one by all pairs."""
    from threadloom.kernels import density
    from threadloom.operators import clustering

    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 0.3, (300, 3)) for c in (0, 5)] + [np.repeat(r.normal(9, 0.1, (4, 3)), 20, 0)])
    for samples in (2, 5, 25):
        whole = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
        core = np.sort(whole, 1)[:, samples - 1]
        reach = np.maximum(np.maximum(whole, core), core[:, None])
        best, done, total = reach[0].copy(), np.zeros(len(x), bool), []
        done[0] = True
        for _ in range(len(x) - 1):
            at = int(np.argmin(np.where(done, np.inf, best)))
            total.append(best[at])
            done[at], best = True, np.minimum(best, reach[at])
        assert density.spanning_tree(x, samples)[:, 2] == pytest.approx(np.sort(total), rel=1e-9, abs=1e-12)
    y = np.concatenate([r.normal(c, 0.1, (25_100, 1)) for c in (0, 9)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(y)], "id bigint, x array<double>")
    got = clustering.density_clusters(df, 20_000, 2).toPandas().set_index("id").cluster.sort_index().to_numpy()
    assert len(got) == 50_200 and set(got[:25_100]) - {-1} == {0} and set(got[25_100:]) - {-1} == {1}


def test_topic_coherence_counts_windows_as_an_explosion_would(spark):
    """Windows and pairs by brute force; a long text is counted in linear time."""
    from threadloom.operators import topics

    r = np.random.default_rng(6)
    texts = [[f"w{v}" for v in r.integers(0, 30, n)] for n in (0, 1, 3, 9, 40, 400)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    terms = spark.createDataFrame([(0, "w1"), (0, "w2"), (0, "w3"), (1, "w2"), (1, "w7"), (1, "absent")], "topic int, term string")
    seen = [set(t[s : s + 5]) for t in texts if t is not None for s in range(max(len(t) - 5, 0) + 1)]
    n, count = len(seen), lambda *w: sum(set(w) <= x for x in seen)
    want = {}
    for topic, words in ((0, ["w1", "w2", "w3"]), (1, ["w2", "w7", "absent"])):
        m = np.zeros((3, 3))
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                p = count(a, b) / n + 1e-12
                m[i, j] = np.log(p / (count(a) / n * count(b) / n)) / -np.log(p) if count(a) and count(b) else 0
        s = m.sum(0)
        want[topic] = np.mean([m[i] @ s / (np.linalg.norm(m[i]) * np.linalg.norm(s)) if m[i].any() else 0 for i in range(3)])
    assert {r["topic"]: r["c_v"] for r in topics.coherence(df, terms, 5).collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_change_points_drop_starts_that_can_not_be_best(monkeypatch):
    """Results are those of all starts; a long series of steps takes work by its segments, not by its square."""
    from threadloom.kernels import changepoint

    r, slack = np.random.default_rng(7), changepoint.SLACK
    for n in (4, 30, 120, 250):
        x = np.repeat(r.normal(0, 3, n), r.integers(1, 60, n))[:n] + r.normal(size=n) * 0.3
        monkeypatch.setattr(changepoint, "SLACK", 1e9)
        every = changepoint.change_points(x)
        monkeypatch.setattr(changepoint, "SLACK", slack)
        assert changepoint.change_points(x) == every
    cells, row = [], changepoint.kernel_row
    monkeypatch.setattr(changepoint, "kernel_row", lambda x, at, width: cells.append(at + 1) or row(x, at, width))
    x = np.tile(np.repeat([-0.45, 0.45], 500), 6) + r.random(6000) * 0.2
    assert changepoint.change_points(x) == list(range(499, 5999, 500)) and sum(cells) < 6000 * 1500


def test_hull_leaves_few_points_to_the_stack():
    """Corners are those of the plain stack; the dip of 100,000 values takes far less than the ten seconds it took."""
    import time

    from threadloom.kernels import special

    r = np.random.default_rng(8)
    for n in (3, 65, 500, 3000):
        x, y = np.sort(r.random(n)), np.sort(r.random(n))
        for sign in (1, -1):
            keep: list[int] = []
            for i in range(n):
                while len(keep) > 1 and sign * ((y[keep[-1]] - y[keep[-2]]) * (x[i] - x[keep[-1]]) - (y[i] - y[keep[-1]]) * (x[keep[-1]] - x[keep[-2]])) >= 0:
                    keep.pop()
                keep.append(i)
            assert special._hull(y, x, sign) == keep
    start = time.time()
    special.dip(r.random(100_000))
    assert time.time() - start < 3
