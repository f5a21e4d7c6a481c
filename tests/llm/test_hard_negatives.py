import math

import numpy as np
import pytest
from pyspark.sql import types as T

from provframe.llm import hard_negatives

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("rank", T.StringType()),
        T.StructField("block", T.IntegerType()),
    ]
)


def brute(rows):
    used = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        used.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for k, (anchor, label, vector) in enumerate(used):
        if anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(vector, v)), i, own == label) for j, (i, own, v) in enumerate(used) if j != k and len(v) == len(vector)]
        scored.sort()
        for score, positive, _ in [s for s in scored if s[2]][:5]:
            inside = [(i, -s) for s, i, same in scored if not same and 30 * -score <= 100 * -s <= 90 * -score]
            out += [(anchor, positive, n, i, -score, s) for n, (i, s) in enumerate(inside[:10], 1)]
    return sorted(out)


def mined(spark, rows, parts=3):
    return sorted(tuple(r) for r in hard_negatives.mined(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect())


@pytest.mark.parametrize("block_rows", [hard_negatives.BLOCK_ROWS, 37])
@pytest.mark.parametrize("spread, dims", [(1.0, 16), (0.02, 7), (500.0, 5)])
def test_equals_brute_force(spark, monkeypatch, block_rows, spread, dims):
    """Ordinary components, ones so small that nearly all scores tie, and ones beyond small integers."""
    for name, value in (("BLOCK_ROWS", block_rows), ("CELL_ROWS", 100), ("CELL_ANCHORS", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    dealt = np.random.default_rng(dims)
    rows = [(25 * k, dealt.normal(0.3 if k % 3 else 0, spread, dims).tolist(), int(dealt.integers(0, 4)), "x", 1) for k in range(400)]
    assert mined(spark, rows) == brute(rows) != []


def test_a_hot_vector(spark):
    """A third of all rows are one vector, with and without one id."""
    dealt = np.random.default_rng(3)
    rows = [(k, [1.0, 0.5, 0.25], k % 2, None, None) for k in range(0, 300, 3)] + [(50, [1.0, 0.5, 0.25], 1, None, None)] * 40
    rows += [(k, dealt.normal(0.5, 0.3, 3).tolist(), k % 2, None, None) for k in range(0, 400, 5)]
    assert mined(spark, rows) == brute(rows) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1, None, None), (100, [1.0, nan], 1, None, None), (200, [1.0, None], 1, None, None), (300, [inf, 1.0], 1, None, None)]
    rows += [(400, [1.0, 1.0], None, None, None), (None, [1.0, 1.0], 1, None, None), (500, [], 1, None, None), (501, [], 1, None, None), (502, [], 2, None, None)]
    rows += [(600, [1.0, 1.0], 3, None, None)] * 3 + [(601, [1.0, 0.9], 3, None, None), (602, [0.5, 0.5], 4, None, None), (603, [1.0], 4, None, None)]
    rows += [(-100, [-1.0, 2.0], 5, None, None), (-99, [1.0, 0.5], 5, None, None), (-98, [-0.1, 0.1], 6, None, None)]
    assert mined(spark, rows) == brute(rows) != []
    large = [(800, [1e7, 3e6], 1, None, None), (801, [1e3, 5e3], 1, None, None), (802, [7e2, 1e3], 2, None, None), (803, [3e2, 3e3], 2, None, None)]
    assert mined(spark, large) == brute(large) != []
    assert mined(spark, []) == [] == mined(spark, rows[:6]) == mined(spark, [(1, [1.0], 1, None, None)])
