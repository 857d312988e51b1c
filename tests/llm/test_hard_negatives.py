"""Hard negatives against an exhaustive search."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.llm import hard_negatives as hn

SCHEMA = "id long, label long, v array<float>"


def plain(rows, every=100, positives=5, negatives=10):
    kept = [(i, l, [max(-hn.EDGE, min(hn.EDGE, math.floor(256 * float(np.float32(x))))) for x in v]) for i, l, v in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (a, label, av) in enumerate(kept):
        if a % every:
            continue
        scored = sorted((-dot(av, v), i, l) for m, (i, l, v) in enumerate(kept) if m != n)
        for score, p, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score][:negatives]
            out += [(a, p, k + 1, s[1], -score, -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r) for r in hn.mine(df, "id", "label", "v", **how).collect())


def cloud(n, dim, seed, spread=0.3):
    """Clusters, so that bounds have something to cut, with copies and ties."""
    dice = random.Random(seed)
    centres = [[dice.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        mid = dice.choice(centres)
        rows.append((i, dice.choice([0, 0, 0, 1, 2, 3]), [x + dice.gauss(0, spread) for x in mid]))
        if i % 10 == 9:
            rows[-1] = (i, rows[-1][1], rows[-2][2])
    return rows


@pytest.mark.parametrize("dim,every", [(16, 20), (7, 10), (1, 25)])
def test_equals_exhaustive_search(spark, dim, every):
    rows = cloud(700, dim, dim)
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(6), every=every)
    assert got == plain(rows, every) and got


def test_small_slices_and_chunks(spark):
    """Many slices and anchor chunks give the same rows."""
    rows = cloud(400, 8, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = hn.build(df, "id", "label", "v")
    anchors = index.rows.where("id % 20 = 0").withColumn("lo", F.array(F.lit(hn._NONE))).withColumn("hi", F.array(F.lit(hn._ALL)))
    shape = lambda d: sorted(tuple(r) for r in d.select("a_id", "place", "score", "id").collect())
    assert shape(hn.best(index, anchors, 20, 5, True, slice_rows=25, chunk=3)) == shape(hn.best(index, anchors, 20, 5, True)) != []


def test_nulls_odd_vectors_ties_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (100, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.5]), (3, 2, [0.5, 0.5]), (4, 2, [0.5]), (5, 2, []), (6, 3, [0.8, -1.0, 9.0]),
            (None, 2, [0.5, 0.5]), (7, None, [0.5, 0.5]), (8, 2, None), (9, 2, [0.5, None]), (10, 2, [nan, 1.0]), (11, 2, [inf, 1.0]), (12, 2, [1e30, -1e30]),
            (200, 4, [-1.0, 0.0]), (300, 5, [0.0, 0.0]), (13, 5, [0.0, 0.0]), (14, 4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "unit", "kind", "lo", "hi", "a_row", "place", "score"):
        df = df.withColumn(name, F.lit("mine"))
    assert mined(df) == plain(rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(100, 1, [1.0, 0.2]), (100, 1, [0.2, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.4]), (2, 2, [0.4, 0.5]), (3, 2, [0.6, 0.6])]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty_table(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, 1, [0.5])], SCHEMA)) == []


def test_large_components_stay_exact(spark):
    dice = random.Random(8)
    rows = [(i * 10, i % 3, [dice.uniform(-60_000, 60_000) for _ in range(4)]) for i in range(60)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_walk_is_in_falling_order_and_complete():
    dice = np.random.default_rng(1)
    a, b = dice.normal(size=9), dice.normal(size=7)
    a[3] = -np.inf
    got = list(hn.falling_cells(a, b))
    assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(9) if i != 3 for j in range(7)]
    assert [s for s, _, _ in got] == sorted((s for s, _, _ in got), reverse=True)
    assert all(s == a[i] + b[j] for s, i, j in got)


def test_bounds_hold_and_the_walk_stops_early():
    """Every score lies between its cell's bounds; on clustered rows most of them are never scored."""
    dice = np.random.default_rng(2)
    centres = dice.normal(size=(12, 16)) * 300
    x = np.rint(centres[dice.integers(0, 12, 4000)] + dice.normal(size=(4000, 16)) * 10)
    index = hn.Slice(hn.fit(x), x, np.arange(4000), np.arange(4000), np.zeros(4000, int))
    bounds = index.half_bounds(x[:5])
    words = len(index.books.second)
    for n in range(5):
        for cell in range(len(index.ends) - 1):
            part = index.x[index.ends[cell] : index.ends[cell + 1]] @ x[n]
            if len(part):
                i, j = divmod(cell, words)
                assert bounds[0][1][n][i] + bounds[1][1][n][j] <= part.min() and part.max() <= bounds[0][0][n][i] + bounds[1][0][n][j]
        seen = []

        class Counted(hn.Best):
            def add(self, scores, ids, rows):
                seen.extend(ids.tolist())
                super().add(scores, ids, rows)

        wanted = Counted(hn._NONE, hn._ALL, 5)
        hn.search(index, x[n], [(u[n], l[n]) for u, l in bounds], [wanted], 0, n, True)
        order = sorted((-(x[k] @ x[n]), k) for k in range(4000) if k != n)[:5]
        assert wanted.held[:, 1].tolist() == [k for _, k in order] and len(seen) < 2500
