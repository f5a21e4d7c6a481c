"""Range joins whose pairs are counted in order, or distinct by construction, against all pairs."""

import random
from collections import Counter

import pytest

from provframe import BX, NX, B, N
from provframe.operators import pairs
from provframe.plans import catalogue
from provframe.sources.annotate import annotate

NAN = float("nan")
LEFT, RIGHT = "a string, v bigint, x double, i bigint", "b string, low bigint, high bigint, y double, j bigint"


def rows(seed):
    rng = random.Random(seed)
    some = lambda *values: rng.choice(values)
    number = lambda: some(None, -0.0, 0.0, 1.5, 7.0, NAN, float("inf"), -3.25, rng.uniform(-9, 9))
    whole = lambda: some(None, -(2**63), 2**63 - 1, 0, *range(-6, 7))
    left = [(some("p", "q", None), whole(), number(), rng.randrange(40)) for _ in range(150)]
    right = []
    for _ in range(60):
        low = whole()
        high = some(whole(), None if low is None else max(-(2**63), min(low + rng.randrange(-1, 9), 2**63 - 1)))
        right.append((some("s", None), low, high, number(), rng.randrange(20)))
    return left, right


def greater(x, y):
    """As SQL orders doubles: NaN is equal to itself and above all others."""
    return (x != x and y == y) or x > y


def matches(left, right):
    for a, v, x, i in left:
        for b, low, high, y, j in right:
            if None not in (v, x, low, high, y) and low <= v <= high and greater(x, y):
                yield a, b, i, j


def joined(spark, semiring, left, right):
    one = annotate(spark.createDataFrame(left, LEFT), semiring, "l", ["i"])
    two = annotate(spark.createDataFrame(right, RIGHT), semiring, "r", ["j"])
    return one.join(two, between=("v", "low", "high"), above=("x", "y")).project("b", "a")


@pytest.mark.parametrize("seed", range(2))
def test_counted_pairs(spark, seed):
    left, right = rows(seed)
    want = Counter((b, a) for a, b, _, _ in matches(left, right))
    assert {(r["b"], r["a"]): int(r["n"]) for r in joined(spark, N, left, right).result().collect()} == want
    assert {tuple(r) for r in joined(spark, B, left, right).result().collect()} == set(want)


def test_distinct_pairs(spark):
    left, right = rows(3)
    want = Counter((b, a, i, j) for a, b, i, j in matches(left, right))
    for semiring, names in ((BX, ["clauses", "literals"]), (NX, ["terms", "coefficients", "degree"])):
        frame = joined(spark, semiring, left, right)
        plain = frame.where("true")  # no longer only a join
        assert plain.pairs is None or plain.pairs.df is not plain.df
        key = lambda r: str(r)
        assert sorted(frame.stats(digest=True).collect(), key=key) == sorted(plain.stats(digest=True).collect(), key=key)
        found = {(r["b"], r["a"]): [r[n] for n in names] for r in frame.stats().collect()}
        for (b, a), values in found.items():
            own = [n for (b2, a2, _, _), n in want.items() if (b2, a2) == (b, a)]
            assert values == [len(own), 2 * len(own)] if semiring is BX else values == [len(own), sum(own), 2 * len(own)]
        assert set(found) == {(b, a) for b, a, _, _ in want}
        assert frame.equals(plain)


def test_days_make_no_pairs_and_move_none(spark, monkeypatch):
    """In B and N nothing is joined but rows and the tuples of their cell; in B[X] pairs of lone rows are not shuffled."""
    made = []
    monkeypatch.setattr(pairs, "_counted", lambda f, own=pairs._counted: made.append(own(f)) or made[-1])
    for tag in ("bool", "nat"):
        plan = catalogue.QUERIES[f"join_range_days_{tag}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
        assert "__own_bin" not in plan
    assert len(made) == 2 and None not in made
    frame = joined(spark, BX, [("p", 1, 2.0, 1)], [("s", 0, 3, 1.0, 1)])
    assert frame.merge().is_merged and len(frame.merge().df.collect()) == 1
