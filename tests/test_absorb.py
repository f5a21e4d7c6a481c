"""Absorption against brute force."""

import random

import pytest

from provframe import BX, annotate, from_terms
from provframe.operators.absorb import absorb

from . import brute
from .helpers import collected


def random_formulas(seed, tuples, variables, clauses, longest, with_true=False):
    rng = random.Random(seed)
    names = [f"v{i}" for i in range(variables)]
    out = {}
    for t in range(tuples):
        key = None if t == 0 else t
        out[key] = {
            tuple(sorted(rng.sample(names, rng.randint(1, longest)))) for _ in range(rng.randint(1, clauses))
        }
        if with_true and t % 3 == 0:
            out[key].add(())
    return out


def as_frame(spark, formulas):
    rows = [(k, list(c)) for k, cs in formulas.items() for c in cs]
    return from_terms(spark.createDataFrame(rows, "k int, c array<string>"), BX, "c")


def as_sets(frame):
    out = {}
    for r in frame.df.collect():
        out.setdefault(r["k"], set()).add(frozenset(r["__names"]))
    return out


@pytest.mark.parametrize("with_true", [False, True])
def test_random_formulas(spark, with_true):
    formulas = random_formulas(7, tuples=12, variables=7, clauses=25, longest=6, with_true=with_true)
    got = as_sets(absorb(as_frame(spark, formulas)))
    assert got == {k: brute.absorbed(cs) for k, cs in formulas.items()}


def test_one_tuple_holding_most_clauses(spark):
    hot = random_formulas(3, tuples=1, variables=40, clauses=1, longest=1)
    rng = random.Random(5)
    names = [f"v{i:02d}" for i in range(60)]
    hot[None] = {tuple(sorted(rng.sample(names, rng.choice([2, 3, 4])))) for _ in range(3000)}
    hot[1] = {("a",), ("a", "b")}
    got = as_sets(absorb(as_frame(spark, hot)))
    assert got == {k: brute.absorbed(cs) for k, cs in hot.items()}


def test_long_clauses(spark):
    names = [f"v{i:02d}" for i in range(30)]
    cs = {tuple(names), tuple(names[:20]), tuple(names[5:25]), tuple(names[2:4]), tuple(names[10:]), ("zz",) + tuple(names[1:3])}
    cs = {tuple(sorted(c)) for c in cs}
    got = as_sets(absorb(as_frame(spark, {1: cs})))
    assert got == {1: brute.absorbed(cs)}


def test_repeats_and_order_inside_a_clause(spark):
    f = as_frame(spark, {1: [("b", "a", "a"), ("a", "b"), ("c",)], 2: [("x", "x"), ("x",)]})
    assert collected(f) == {(1,): "(a ∧ b) ∨ (c)", (2,): "(x)"}


def test_plan_proves_that_nothing_absorbs(spark):
    t = lambda name: annotate(spark.createDataFrame([(1,)], f"{name}_k int"), BX, name, [f"{name}_k"])
    joined = t("left").cross(t("right"))
    assert joined.sizes == frozenset({2})
    plan = joined.project("left_k").absorb().df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan
    mixed = joined.project("left_k").msum(t("left"))
    assert mixed.sizes == frozenset({1, 2})
    # a space whose variables could spell like another's is not treated as disjoint
    assert t("t").cross(t("t_1")).sizes == frozenset({1, 2})


def test_lookups_are_equi_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = as_frame(spark, random_formulas(1, 4, 6, 10, 4, with_true=True))
        f = f.msum(f)
        plan = absorb(f).df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("length", [3, 16, 64])
def test_joins_do_not_depend_on_clause_length(spark, length):
    names = [f"v{i:03d}" for i in range(length)]
    f = as_frame(spark, {1: [tuple(names), tuple(names[: length // 2 + 1]), (names[0], "zz")]})
    plan = absorb(f).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3
    assert as_sets(absorb(f)) == {1: brute.absorbed({tuple(names), tuple(names[: length // 2 + 1]), (names[0], "zz")})}


def test_shapes_of_witnesses_absorb_without_names(spark):
    """Clauses of one to three leaves of apart tables: only native columns meet, and equal shapes are added up."""
    from provframe import BX
    from provframe.sources.annotate import annotate

    a = annotate(spark.createDataFrame([(k, k % 3) for k in range(30)], "a long, x long"), BX, "left", ["a"], unique=True)
    b = annotate(spark.createDataFrame([(k, k % 5) for k in range(30)], "b long, y long"), BX, "right", ["b"], unique=True)
    c = annotate(spark.createDataFrame([(k,) for k in range(30)], "c long"), BX, "third", ["c"], unique=True)
    ab, abc = a.join(b, [("a", "b")]), a.join(b, [("a", "b")]).join(c, [("b", "c")])
    f = abc.project("x").msum(ab.where("y = 1").project("x")).msum(ab.where("y < 2").project("x")).msum(a.where("a % 4 = 0").project("x")).msum(b.where("b = 6").rename({"y": "x"}).project("x"))
    assert f.witness_shapes == {frozenset(s) for s in ((0, 1, 2), (0, 1), (0,), (1,))}
    wanted = {k % 3: set() for k in range(3)}
    for k in range(30):
        if k % 4 == 0:
            wanted[k % 3].add((f"left_{k}",))
        elif k % 5 < 2:
            wanted[k % 3].add((f"left_{k}", f"right_{k}"))
        else:
            wanted[k % 3].add((f"left_{k}", f"right_{k}", f"third_{k}"))
    wanted[1].add(("right_6",))
    found = f.terms()
    rows = [(r.x, tuple(r.term[1:-1].split(" ∧ "))) for r in found.collect()]
    assert len(rows) == len(set(rows)) and {k: {t for x, t in rows if x == k} for k in wanted} == wanted
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_shapes_with_a_common_leaf_move_once(spark):
    """clauses that all name a row of one table are dealt by it once, also with repeated rows and NULL, zero and NaN in tuples."""
    rng = random.Random(4)
    value = lambda: rng.choice([None, 0.0, -0.0, float("nan"), 1.5])
    rows = [(k % 25, value(), rng.randrange(6)) for k in range(60)]
    a = annotate(spark.createDataFrame(rows + rows[:9], "a long, x double, p long"), BX, "left", ["a"])
    b = annotate(spark.createDataFrame([(k % 9, k % 6) for k in range(30)], "b long, q long"), BX, "right", ["b"])
    c = annotate(spark.createDataFrame([(k % 7, k % 9) for k in range(20)], "c long, r long"), BX, "third", ["c"])
    ab = a.join(b, [("p", "q")])
    abc, ac = ab.join(c, [("b", "r")]), a.join(c, [("p", "r")])
    parts = [abc.project("x"), ab.where("b % 3 = 0").project("x"), ac.where("c < 4").project("x"), a.where("a % 4 = 0").project("x")]
    f = parts[0]
    for part in parts[1:]:
        f = f.msum(part)
    assert f.witness_shapes == {frozenset(s) for s in ((0, 1, 2), (0, 1), (0, 2), (0,))}
    key = lambda x: None if x is None else repr(x + 0.0)
    wanted = {}
    for part in parts:
        for r in part.terms().collect():
            wanted.setdefault(key(r.x), set()).add(frozenset(r.term[1:-1].split(" ∧ ")))
    wanted = {(x, clause) for x, clauses in wanted.items() for clause in clauses if not any(other < clause for other in clauses)}
    found = f.terms()
    rows = [(key(r.x), frozenset(r.term[1:-1].split(" ∧ "))) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted
    plan = f.terms()._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("REPARTITION_BY_COL") == 1
    above = plan[: plan.index("REPARTITION_BY_COL")]
    assert above.count("Exchange ") == 1
