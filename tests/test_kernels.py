import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from threadloom.kernels import changepoint, special
from threadloom.operators import echo, eda, graph


def samples(n_samples, seed):
    r = np.random.Generator(np.random.PCG64(seed))
    for k in range(n_samples):
        n = int(r.integers(4, 50))
        yield [r.normal(size=n), r.random(n), np.concatenate([r.normal(size=n), r.normal(6, 1, n)]), r.integers(0, 7, n).astype(float)][k % 4]


def dip_by_all_modes(values):
    """The dip from its definition: every value is tried as the mode."""
    x = np.sort(values)
    points, counts = np.unique(x, return_counts=True)
    high = np.cumsum(counts) / len(x)
    low = high - counts / len(x)

    def line(a, b, y):  # the chord of two points, over all
        return y[a] + (y[b] - y[a]) * (points - points[a]) / (points[b] - points[a])

    best = 1.0
    for m in range(len(points)):
        below = max((high[i] - min([low[i]] + [line(a, b, low)[i] for a in range(i) for b in range(i + 1, m + 1)]) for i in range(m + 1)), default=0)
        above = max(max([high[i]] + [line(a, b, high)[i] for a in range(m, i) for b in range(i + 1, len(points))]) - low[i] for i in range(m, len(points)))
        best = min(best, max(below, above))
    return best / 2


def test_dip_is_the_best_of_all_modes():
    for x in samples(24, 3):
        x = x[:14]
        if len(np.unique(x)) > 1:
            assert special.dip(x) == pytest.approx(dip_by_all_modes(x), abs=1e-12)


def test_dip_test_uses_samples_of_the_same_size(monkeypatch):
    sizes = []
    whole = special.dip
    monkeypatch.setattr(special, "dip", lambda v: sizes.append(len(v)) or whole(v))
    r = np.random.Generator(np.random.PCG64(1))
    assert special.dip_test(np.concatenate([r.normal(size=260), r.normal(9, 1, 260)]), 20)[1] == 0.0
    assert sizes == [520] * 21


def by_full_kernel(x, penalty=3.0, least=2):
    """Least cost over all segmentations, with the whole kernel matrix."""
    d = (x[:, None] - x[None, :]) ** 2
    width = np.median(d[np.triu_indices(len(x), 1)]) or 1.0
    k = np.exp(-np.clip(d / width, 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    cost = lambda a, b: b - a - k[a:b, a:b].sum() / (b - a)
    best = {0: (-penalty, ())}
    for end in range(least, len(x) + 1):
        best[end] = min((best[s][0] + cost(s, end) + penalty, (*best[s][1], s - 1)) for s in best if end - s >= least)
    return list(best[len(x)][1][1:])


def test_change_points_by_full_kernel():
    r = np.random.Generator(np.random.PCG64(5))
    found = 0
    for n in (4, 5, 9, 30, 60):
        for jump in (0.0, 2.0, 9.0):
            x = np.concatenate([r.normal(size=n // 2), r.normal(jump, 1, n - n // 2)])
            got = changepoint.change_points(x)
            assert got == by_full_kernel(x)
            found += len(got)
    assert found > 3 and changepoint.change_points([1.0] * 20) == []


def test_gram():
    """Squared distances 1, 4 and 9, so the width is 4; no distances: width 1, exponents of 0.01 at least."""
    e = np.exp([-0.25, -1.0, -2.25])
    assert changepoint.gram([0, 1, 3]) == pytest.approx(np.array([[1, e[0], e[2]], [e[0], 1, e[1]], [e[2], e[1], 1]]), rel=1e-12)
    assert changepoint.gram([2.0, 2.0])[0] == pytest.approx([1, np.exp(-0.01)]) and changepoint.gram([]).shape == (0, 0)


def test_median_square_and_long_series():
    for x in samples(40, 8):
        d = (x[:, None] - x[None, :])[np.triu_indices(len(x), 1)] ** 2
        assert changepoint.median_square(x) == pytest.approx(np.median(d), rel=1e-12, abs=1e-300)
    start = time.time()
    assert changepoint.change_points(np.repeat([0.0, 5.0], 3000)) == [2999] and time.time() - start < 60


def test_label_propagation_ends(spark):
    """Two triangles joined by one edge are two communities; a lone pair swaps labels and still ends."""
    people = spark.createDataFrame([(i,) for i in range(9)], "user_id bigint")
    pairs = spark.createDataFrame([(0, 1, 2), (0, 2, 2), (1, 2, 2), (3, 4, 2), (3, 5, 2), (4, 5, 2), (2, 3, 1), (6, 7, 1)], "a bigint, b bigint, weight bigint")
    got = {r["node"]: r["community"] for r in graph.label_propagation(people, pairs).collect()}
    assert got[0] == got[1] == got[2] != got[3] == got[4] == got[5] and got[8] == 8
    with pytest.raises(RuntimeError):
        graph.components(people, pairs, 1)


def test_header_artefacts_and_medians(spark):
    df = spark.createDataFrame([("id", 1.0), (None, 2.0), ("a", 3.0), ("a", 10.0), ("b", None)], "k string, v double")
    assert sorted(r["k"] for r in eda.drop_artefact(df, "k", ("id",)).collect()) == ["a", "a", "b"] and eda.drop_artefact(df, "k").count() == 4
    got = {r["k"]: (r["median"], r["n"]) for r in eda.medians(df, "v", "k").collect()}
    assert got["a"] == (6.5, 2) and got["b"] == (None, 0)
    other = spark.createDataFrame([("a", 7)], "k string, w int")
    assert {(r["k"], r["w"]) for r in eda.side_by_side(df, other, "k").collect()} >= {("a", 7), ("b", None)}


def test_polarization_of_both_attitudes_and_of_parts(spark):
    rows = [(i, (-1) ** i * 0.5, (-1) ** i * 0.9, 0.2 * (i % 3), "p" if i < 8 else None if i == 9 else "q") for i in range(14)]
    users = spark.createDataFrame(rows, "user_id bigint, mean_attitude double, propagated_attitude double, exposure_diversity double, sub_community string")
    both = {r["attitudes"]: r for r in echo.compare_polarization(users).collect()}
    assert both["original"]["variance"] == pytest.approx(0.25) and both["propagated"]["inter_group_distance"] == pytest.approx(1.8)
    pairs = spark.createDataFrame([(0, 2, 1), (1, 3, 1), (0, 9, 1), (10, 12, 5), (11, 12, 1), (1, 12, 1)], "a bigint, b bigint, weight bigint")
    got = {r["sub_community"]: r for r in echo.sub_community_scores(users, pairs).collect()}
    assert set(got) == {"p", "q"} and got["p"]["size"] == 8 and got["q"]["size"] == 5
    assert got["p"]["homophily"] == pytest.approx(1.0) and got["q"]["homophily"] == pytest.approx(0.25) and got["p"]["separation"] == 0
    assert got["p"]["diversity"] == pytest.approx(1 - users.where("user_id < 8").agg(F.avg("exposure_diversity")).first()[0])
