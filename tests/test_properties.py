"""Random expressions over random small tables, in four semirings, against the model."""

import random

import pytest

from provframe import Dedup

from . import brute
from .helpers import SEMIRINGS, collected, frame

SCHEMA = ["x", "y"]


def random_table(rng, prefix):
    rows = {}
    for i in range(rng.randint(3, 6)):
        row = (rng.choice([None, 0, 1]), rng.randint(0, 2))
        rows[row] = brute.add(rows.get(row, {}), brute.var(f"{prefix}{i}"))
    return rows


def build(rng, depth, tables):
    """(function on frames, function on models): the same random expression twice."""
    if depth == 0:
        name = rng.choice(sorted(tables))
        return (lambda t: t[name]), (lambda m: m[name])
    left_f, left_m = build(rng, depth - 1, tables)
    kind = rng.choice(["select", "sum", "join", "swap", "collapse", "exists"])
    if kind == "select":
        c = rng.randint(0, 2)
        return (lambda t: left_f(t).where(f"y <> {c}")), (lambda m: brute.select(left_m(m), lambda r: r[1] != c))
    if kind == "swap":
        swap = lambda f: f.project("y", "x").rename({"y": "x", "x": "y"}).where("y IS NOT NULL")
        return (lambda t: swap(left_f(t))), (
            lambda m: brute.select(brute.project(left_m(m), [1, 0]), lambda r: r[1] is not None)
        )
    if kind == "collapse":
        return (
            lambda t: left_f(t).project("y").cross(t["unit"]).project("u", "y").rename({"u": "x"})
        ), (lambda m: {(0, *r): p for r, p in brute.project(left_m(m), [1]).items()})
    if kind == "exists":
        return (lambda t: left_f(t).dedup(Dedup.EXISTENCE)), (lambda m: brute.exists(left_m(m)))
    right_f, right_m = build(rng, depth - 1, tables)
    if kind == "sum":
        return (lambda t: left_f(t).msum(right_f(t))), (lambda m: brute.msum(left_m(m), right_m(m)))
    return (
        lambda t: left_f(t)
        .join(right_f(t).rename({"x": "rx", "y": "ry"}), [("x", "rx")])
        .project("x", "ry")
        .rename({"ry": "y"})
    ), (
        lambda m: brute.project(
            brute.select(
                brute.cross(left_m(m), right_m(m)), lambda r: r[0] is not None and r[0] == r[2]
            ),
            [0, 3],
        )
    )


@pytest.mark.parametrize("seed", range(8))
def test_random_expressions(spark, seed):
    rng = random.Random(seed)
    models = {n: random_table(rng, n) for n in ("a", "b")}
    on_frames, on_models = build(rng, 3, models)
    want = {r: p for r, p in on_models(models).items() if p}
    for s in SEMIRINGS:
        tables = {
            n: frame(spark, s, "x int, y int", list(m.items())) for n, m in models.items()
        }
        tables["unit"] = frame(spark, s, "u int", [((0,), brute.one())])
        assert collected(on_frames(tables)) == brute.image(want, s.name), (seed, s.name)
