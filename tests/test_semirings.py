"""Semiring laws, checked on one-tuple relations: ⊎ adds and × multiplies."""

import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from provframe import Dedup, N, Semiring, Weight
from provframe.sources.annotate import annotate

from . import brute
from .helpers import IDS, SEMIRINGS, collected, frame

SAMPLES = [
    {},
    brute.one(),
    brute.var("x"),
    brute.add(brute.var("x"), brute.mul(brute.var("y"), brute.var("y"))),
    brute.add(brute.one(), brute.mul(brute.var("x"), brute.var("z"))),
]


def combos(spark, semiring, build, arity):
    """One Spark job for every combination: the combination number is an attribute."""
    picks = list(itertools.product(range(len(SAMPLES)), repeat=arity))
    inputs = []
    for i in range(arity):
        inputs.append(
            frame(spark, semiring, "k int", [((n,), SAMPLES[p[i]]) for n, p in enumerate(picks)])
        )
    return collected(build(*inputs))


def times(a, b):
    """Pointwise product: join on the combination number."""
    return a.join(b.rename({"k": "k2"}), [("k", "k2")]).project("k")


@pytest.mark.parametrize("semiring", SEMIRINGS, ids=IDS)
def test_addition_laws(spark, semiring):
    plus = lambda a, b: a.msum(b)
    assert combos(spark, semiring, plus, 2) == combos(spark, semiring, lambda a, b: b.msum(a), 2)
    assert combos(spark, semiring, lambda a, b, c: a.msum(b).msum(c), 3) == combos(
        spark, semiring, lambda a, b, c: a.msum(b.msum(c)), 3
    )


@pytest.mark.parametrize("semiring", SEMIRINGS, ids=IDS)
def test_multiplication_and_distribution(spark, semiring):
    assert combos(spark, semiring, times, 2) == combos(spark, semiring, lambda a, b: times(b, a), 2)
    assert combos(spark, semiring, lambda a, b, c: times(times(a, b), c), 3) == combos(
        spark, semiring, lambda a, b, c: times(a, times(b, c)), 3
    )
    assert combos(spark, semiring, lambda a, b, c: times(a, b.msum(c)), 3) == combos(
        spark, semiring, lambda a, b, c: times(a, b).msum(times(a, c)), 3
    )


@pytest.mark.parametrize("semiring", SEMIRINGS, ids=IDS)
def test_against_the_model(spark, semiring):
    picks = list(itertools.product(SAMPLES, repeat=2))
    for op, model in ((lambda a, b: a.msum(b), brute.add), (times, brute.mul)):
        want = {(n,): model(p, q) for n, (p, q) in enumerate(picks)}
        want = {t: p for t, p in want.items() if p}
        assert combos(spark, semiring, op, 2) == brute.image(want, semiring.name)


def test_idempotence(spark):
    for s in SEMIRINGS:
        twice = combos(spark, s, lambda a: a.msum(a), 1)
        once = combos(spark, s, lambda a: a, 1)
        assert (twice == once) == (s.name in ("B", "B[X]"))


@pytest.mark.parametrize("semiring", SEMIRINGS, ids=IDS)
def test_zero_and_one(spark, semiring):
    k = frame(spark, semiring, "k int", [((1,), brute.var("x"))])
    unit = k.rename({"k": "u"}).dedup(Dedup.EXISTENCE)
    assert collected(k.cross(unit).project("k")) == collected(k)
    nothing = k.where("k > 1")
    assert collected(k.msum(nothing)) == collected(k)
    assert collected(k.cross(nothing.rename({"k": "z"}))) == {}


def test_counts_beyond_long_and_overflow(spark):
    big = spark.createDataFrame([("a", Decimal(10) ** 18)], "k string, w decimal(38,0)")
    f = annotate(big, N, weight="w")
    squared = f.cross(f.alias("o")).project("k")
    assert collected(squared) == {("a",): 10**36}
    with pytest.raises(Exception, match="(?i)overflow|exceeds|out of range|NUMERIC_VALUE"):
        collected(squared.cross(f.alias("p")).project("k"))


def test_overflow_raises_without_ansi(spark):
    big = spark.createDataFrame([("a", Decimal(10) ** 20)], "k string, w decimal(38,0)")
    f = annotate(big, N, weight="w")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="exceeds"):
            f.cross(f.alias("o")).project("k").result().collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_user_defined_semiring(spark):
    """Shortest path cost: + is min, · is +."""
    cheapest = Semiring(
        "min-plus",
        weight=Weight("double", float("inf"), 0.0, plus=F.min, times=lambda a, b: a + b),
    )
    edges = spark.createDataFrame(
        [("a", "b", 1.0), ("a", "c", 5.0), ("b", "d", 1.0), ("c", "d", 1.0), ("c", "e", float("inf"))],
        "src string, dst string, cost double",
    )
    e = annotate(edges, cheapest, weight="cost")
    two = e.alias("x").join(e.alias("y"), [("x_dst", "y_src")]).project("x_src", "y_dst")
    assert {tuple(r) for r in two.result("cost").collect()} == {("a", "d", 2.0)}


def test_mixing_semirings_is_refused(spark):
    a, b = (frame(spark, s, "k int", [((1,), brute.one())]) for s in SEMIRINGS[:2])
    for op in (lambda: a.msum(b), lambda: a.cross(b.alias("o")), lambda: a.minus(b), lambda: a.intersect(b)):
        with pytest.raises(ValueError, match="semirings"):
            op()
