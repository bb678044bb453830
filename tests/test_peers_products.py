import itertools
import math
import random

import numpy as np
import pytest

from drawlens.operators.metrics import drift, lattice_p_value
from drawlens.operators.peers import Cells, nearest_of_all
from drawlens.operators.products import correlations, covariances


def plain_peers(rows, limit):
    out = []
    for i, x in rows:
        if i is None or any(v is None or v != v for v in x):
            continue
        near = sorted({(math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))), j) for j, y in rows if j is not None and j != i and all(v is not None and v == v for v in y)})
        best = {}
        for d, j in near:
            best.setdefault(j, d)
        out += [(i, j, round(d, 9), n) for n, (j, d) in enumerate(list(best.items())[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("per_cell,limit", [(4, 3), (16, 8), (10_000, 2)])
def test_all_peers_against_all_pairs(spark, per_cell, limit):
    rng = random.Random(per_cell)
    rows = [(f"m{i:03}", (rng.choice((0.0, 0.5, rng.random())), rng.choice((1.0, rng.gauss(0, 3))))) for i in range(260)]
    rows += [(f"same{i}", (0.25, 0.25)) for i in range(40)] + [("far", (1e6, -1e6)), ("zero", (-0.0, 1.0)), (None, (0.0, 0.0)), ("null", (None, 1.0)), ("nan", (math.nan, 1.0))]
    df = spark.createDataFrame([(i, *x) for i, x in rows], "k string, a double, b double").repartition(3)
    got = sorted((r.k, r.peer, round(r.distance, 9), r.place) for r in nearest_of_all(df, "k", ["a", "b"], limit, per_cell).collect())
    assert got == plain_peers(rows, limit)
    few = df.where("k IN ('far', 'zero')")
    assert nearest_of_all(few, "k", ["a", "b"], limit).count() == 2 and nearest_of_all(df.limit(0), "k", ["a", "b"]).count() == 0


def test_cells_are_about_equal():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=(3000, 2)), np.zeros((1000, 2)), np.stack((np.zeros(1000), rng.random(1000)), axis=1)))
    cells = Cells(np.unique(x, axis=0), 64)
    sizes = np.bincount(cells.of(np.unique(x, axis=0)), minlength=cells.count)
    assert cells.count >= 48 and sizes.max() < 5 * sizes.mean()


def test_products_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5)) * [1, 1e-3, 1e5, 1, 0] + [0, 5, 1e9, -3, 7]
    rows = [[None if rng.random() < 0.1 and j < 3 else float(v) for j, v in enumerate(r)] for r in x]
    names = list("abcde")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(4)
    corr = {(r.a, r.b): r["corr"] for r in correlations(df, names).collect()}
    cov = {(r.a, r.b): r for r in covariances(df, names).collect()}
    assert len(corr) == len(cov) == 15
    for (i, a), (j, b) in itertools.combinations_with_replacement(enumerate(names), 2):
        both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
        assert cov[a, b].n == len(both) and np.isclose(cov[a, b]["cov"], np.cov(both.T)[0, 1], rtol=1e-7, atol=1e-9 * both[:, 0].std() * both[:, 1].std())
        want = None if both.std(axis=0).min() == 0 else np.corrcoef(both.T)[0, 1]
        assert corr[a, b] is None if want is None else np.isclose(corr[a, b], want, atol=1e-8)
    assert correlations(df.limit(0), names).where("corr IS NOT NULL").count() == 0


def plain_law(ks, n, m):
    orders = list(itertools.combinations(range(n + m), n))
    hit = 0
    for mine in orders:
        i = most = 0
        for step in range(1, n + m + 1):
            i += step - 1 in mine
            most = max(most, abs(i * m - (step - i) * n))
        hit += most >= round(ks * n * m)
    return hit / len(orders)


def test_two_sample_law_against_all_orders(spark):
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 4)):
        for h in range(n * m + 1):
            assert math.isclose(lattice_p_value(h / (n * m), n, m), plain_law(h / (n * m), n, m), abs_tol=1e-12)
    assert lattice_p_value(0.0, 1000, 1000) == 1.0 and 0 < lattice_p_value(0.07, 1000, 990) < 0.03
    a, b = [1.0, 2.0, 2.0, 3.0, 9.0], [2.0, 2.0, 2.0, 4.0]  # ties count in the statistic
    row = drift(spark.createDataFrame([(x,) for x in a], "v double"), spark.createDataFrame([(x,) for x in b], "v double"), ["v"]).first()
    gaps = [abs(sum(x <= t for x in a) / 5 - sum(x <= t for x in b) / 4) for t in {*a, *b}]
    assert math.isclose(row.ks, max(gaps)) and math.isclose(row.p_value, plain_law(row.ks, 5, 4)) and not row.drifted
