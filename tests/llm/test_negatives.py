"""Hard negatives against all pairs of rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cantora.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchors, k=5, low=80):
    fine = {}
    good = [(i, v, b) for i, v, b in rows if i is not None and b is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    usual = max({len(v) for _, v, _ in good}, key=lambda n: (sum(len(v) == n for _, v, _ in good), n), default=0)
    for i, v, b in good:
        if len(v) == usual:
            fine[i] = min(fine.get(i, (v, b)), (v, b))
    whole = {i: ([max(-negatives.CUT, min(negatives.CUT, math.floor(256 * x))) for x in v], b) for i, (v, b) in fine.items()}
    out = []
    for a in anchors:
        if a not in whole:
            continue
        va, la = whole[a]
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, b) for i, (v, b) in whole.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:k]:
            hard = [x for x in scored if x[2] != la and low * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(hard)]
    return sorted(out)


def vectors(rng, n, dims=6, centres=5, spread=0.3):
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(middle)], rng.randrange(3)) for i in range(n)]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit(1), "cell": F.lit("x"), "asks": F.lit(None).cast("string")})
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect())


@pytest.mark.parametrize(("shard", "block"), [(8192, 4096), (40, 7)])
def test_hard_negatives(spark, monkeypatch, shard, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = random.Random(12)
    rows = vectors(rng, 260)
    rows += [(1000 + i, rows[3][1], i % 2) for i in range(40)] + [(2000 + i, rows[10][1], 1) for i in range(30)]  # equal vectors
    odd = [(None, rows[0][1], 1), (3010, None, 1), (3020, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (3030, [float("nan")] * 6, 1), (3040, [float("inf")] * 6, 0), (3050, [1.0, 2.0], 1), (3060, [], 0), (3070, rows[5][1], None)]
    odd += [(3080, [0.0] * 6, 1), (3090, [1e300, -1e300, 0.0, 0.0, 0.0, 0.0], 0), (30, [9.0] * 6, 0), (40, [-9.0] * 6, 0), (40, [-9.0] * 6, 0)]
    rows += odd
    rng.shuffle(rows)
    ids = sorted({i for i, _, _ in rows if i is not None and i % 10 == 0})
    assert found(spark, rows, shard=shard) == brute(rows, ids)


def test_fewer_rows_than_asked(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.9, 0.1], 1), (3, [-1.0, 0.0], 1)]
    assert found(spark, rows) == brute(rows, [0]) == [(0, 1, 1, 2, 65536, 58880)]
    assert found(spark, [(0, [1.0], 0)]) == [] and found(spark, []) == [] and found(spark, [(0, [], 0)]) == []


def test_search_stops_and_skips():
    """Tight lists far from an anchor aren't visited, and what is left out can't be in the result."""
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 400, (40, 8))
    rows = np.floor(np.repeat(middle, 50, axis=0) + rng.normal(0, 4, (2000, 8))).astype(np.int64)
    ids, labels = np.arange(2000), rng.integers(0, 2, 2000)
    shard = pa.table({"v": pa.array(list(rows), pa.list_(pa.int32())), "vec_id": ids, "label": labels})
    lists = negatives._build((pa.scalar(0), pa.scalar(0)), shard)
    top = negatives.MOST
    asks = pa.table({"anchor_id": ids[:20], "label": labels[:20], "v": pa.array(list(rows[:20]), pa.list_(pa.int32())), "wants": [[{"high": top, "low": -top, "floor": -top}]] * 20})
    got, visited = negatives.search(lists, asks, 5, True)
    for a in range(20):
        score = rows @ rows[a]
        same = [i for i in np.lexsort((ids, -score)) if i != a and labels[i] == labels[a]][:5]
        assert [(i, s) for x, _, i, s in got if x == a] == [(i, score[i]) for i in same]
    assert visited < 0.3 * 20 * lists.num_rows


def test_bounds_hold():
    rng = np.random.default_rng(6)
    rows, anchors = np.floor(rng.normal(0, 300, (500, 16))), np.floor(rng.normal(0, 300, (9, 16)))
    centroids = negatives.k_means(rows, 20)
    near = negatives.nearest(rows, centroids)
    low, high = negatives.bounds(anchors, centroids, negatives.radii(rows, centroids, near))
    score = anchors @ rows.T
    assert (low[:, near] <= score).all() and (score <= high[:, near]).all()
