"""Hand-computed annotations for each operator."""

import datetime

import pytest
from pyspark.sql import functions as F

from provframe import BX, NX, B, Dedup, N, annotate

from . import brute
from .helpers import IDS, SEMIRINGS, collected, frame

HOW, EXISTS = Dedup.HOW_PROVENANCE, Dedup.EXISTENCE
v = brute.var


def legs(spark, s, names=("l1", "l2", "l3", "l4")):
    """Which line calls at which stop."""
    rows = [("red", 1), ("red", 3), ("blue", 3), ("green", 5)]
    return frame(spark, s, "line string, stop int", [(r, v(n)) for r, n in zip(rows, names)])


def stops(spark, s, names=("p1", "p2", "p3")):
    rows = [(1, "north"), (3, "harbour"), (4, "mill")]
    return frame(spark, s, "no int, place string", [(r, v(n)) for r, n in zip(rows, names)])


def test_lines_with_known_stops(spark):
    known = lambda s: legs(spark, s).cross(stops(spark, s)).where("stop = no").project("line")
    assert collected(known(NX).dedup(HOW)) == {("red",): "l1·p1 + l2·p2", ("blue",): "l3·p2"}
    assert collected(known(BX).dedup(HOW)) == {("red",): "(l1 ∧ p1) ∨ (l2 ∧ p2)", ("blue",): "(l3 ∧ p2)"}
    assert collected(known(NX).dedup(EXISTS)) == {("red",): "1", ("blue",): "1"}
    assert collected(known(BX).dedup(EXISTS)) == {("red",): "True", ("blue",): "True"}
    assert collected(known(N)) == {("red",): 2, ("blue",): 1}
    assert set(collected(known(B))) == {("red",), ("blue",)}


def test_sums_of_tickets(spark):
    sold = frame(spark, N, "day string, zone int", [(("mon", 1), {(): 4}), (("mon", 2), {(): 9}), (("tue", 2), {(): 7})])
    more = frame(spark, N, "day string, zone int", [(("tue", 2), {(): 6}), (("wed", 1), {(): 8})])
    assert collected(sold.msum(more)) == {("mon", 1): 4, ("mon", 2): 9, ("tue", 2): 13, ("wed", 1): 8}
    assert collected(sold.msum(sold).project("zone")) == {(1,): 8, (2,): 32}
    assert set(collected(sold.msum(more).dedup(EXISTS)).values()) == {1}
    early = frame(spark, BX, "day string", [(("mon",), v("e1")), (("tue",), v("e2"))])
    late = frame(spark, BX, "day string", [(("tue",), v("e9")), (("tue",), v("e2"))])
    assert collected(early.msum(late)) == {("mon",): "(e1)", ("tue",): "(e2) ∨ (e9)"}


def test_multiset_sum_needs_equal_schemas(spark):
    a = frame(spark, N, "x int, y int", [((1, 2), {(): 1})])
    for other in ("y int, x int", "x int, z int"):
        with pytest.raises(ValueError, match="schemas"):
            a.msum(frame(spark, N, other, [((1, 2), {(): 1})]))


def test_product_pairs_everything(spark):
    pairs = legs(spark, BX).where("stop = 3").cross(stops(spark, BX).where("no > 3"))
    assert collected(pairs) == {("red", 3, 4, "mill"): "(l2 ∧ p3)", ("blue", 3, 4, "mill"): "(l3 ∧ p3)"}


def test_projection_order_and_errors(spark):
    r = legs(spark, BX)
    assert collected(r.project("line")) == {("red",): "(l1) ∨ (l2)", ("blue",): "(l3)", ("green",): "(l4)"}
    assert r.project("stop", "line").columns == ["stop", "line"]
    assert r.project(["stop"]).columns == ["stop"]
    for bad in (["track"], ["line", "track"]):
        with pytest.raises(ValueError, match="unknown"):
            r.project(*bad)
    with pytest.raises(ValueError, match="duplicate"):
        r.project("line", "line")
    with pytest.raises(ValueError):
        r.project()
    assert collected(r.project("stop", "line").project("line")) == collected(r.project("line"))


def test_deduplicating_powers(spark):
    cube = brute.mul(v("a"), brute.mul(v("a"), v("a")))
    both = brute.add(brute.mul(v("a"), v("b")), brute.mul(v("b"), v("a")))
    r = frame(spark, NX, "k int", [((1,), brute.add(cube, both)), ((2,), brute.mul(cube, v("b")))])
    assert collected(r.dedup(HOW)) == {(1,): "a^3 + 2·a·b", (2,): "a^3·b"}
    assert collected(r.dedup(EXISTS)) == {(1,): "1", (2,): "1"}
    assert collected(r.dedup(EXISTS).dedup(EXISTS)) == collected(r.dedup(EXISTS))


@pytest.mark.parametrize("semiring", SEMIRINGS, ids=IDS)
def test_zero_rows_are_absent(spark, semiring):
    r = frame(spark, semiring, "Name string", [(("a",), v("x")), (("b",), {})])
    assert set(collected(r)) == {("a",)}
    assert r.support_size() == 1
    assert set(collected(r.dedup(EXISTS))) == {("a",)}
    assert r.lookup(Name="b").support_size() == 0
    assert r.annotation_of(Name="b").count() == 0
    assert r.annotation_of(Name="a").count() == 1


@pytest.mark.parametrize("semiring", SEMIRINGS, ids=IDS)
def test_algebra_laws(spark, semiring):
    r, s = legs(spark, semiring), stops(spark, semiring)
    t = frame(spark, semiring, "no int, place string", [((4, "mill"), v("p9")), ((5, "gate"), v("p8"))])
    assert collected(r.cross(s.msum(t))) == collected(r.cross(s).msum(r.cross(t)))
    assert collected(r.cross(s).where("stop > 2")) == collected(r.where("stop > 2").cross(s))
    assert collected(r.where("stop > 2").where("line = 'red'")) == collected(r.where("line = 'red' AND stop > 2"))
    assert collected(r.msum(r.where("false"))) == collected(r)
    named = s.rename({"no": "stop", "place": "line"}).project("line", "stop")
    assert collected(r.msum(named)) == collected(named.msum(r))


def test_inputs_are_not_changed(spark):
    r = legs(spark, NX)
    before = collected(r)
    r.where("stop = 3").project("line").merge()
    assert collected(r) == before and r.columns == ["line", "stop"]


def test_clashing_names_need_an_alias(spark):
    r = legs(spark, BX)
    with pytest.raises(ValueError, match="alias"):
        r.cross(r)
    with pytest.raises(ValueError, match="reserved"):
        annotate(spark.createDataFrame([(1,)], "__w0 int"), B)


def test_self_join_squares(spark):
    rows = spark.createDataFrame([("even", 2), ("even", 4), ("odd", 7)], "kind string, id int")
    for s, want in (
        (NX, {("even",): "t_2^2 + 2·t_2·t_4 + t_4^2", ("odd",): "t_7^2"}),
        (BX, {("even",): "(t_2) ∨ (t_4)", ("odd",): "(t_7)"}),
    ):
        r = annotate(rows, s, "t", ["id"], keep=["kind"])
        assert collected(r.alias("a").join(r.alias("b"), [("a_kind", "b_kind")]).project("a_kind")) == want


def test_three_way_self_join_keeps_exponents(spark):
    r = annotate(spark.createDataFrame([(1,), (2,)], "k int"), NX, "t", ["k"])
    q = r.alias("a").cross(r.alias("b")).cross(r.alias("c")).project(F.lit("x").alias("x"))
    assert collected(q) == {("x",): "3·t_1^2·t_2 + t_1^3 + 3·t_1·t_2^2 + t_2^3"}


def test_null_is_one_value_in_projection_and_sum(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, id int")
    r = annotate(df, BX, "t", ["id"])
    p = r.project("k")
    assert collected(p) == {(None,): "(t_1) ∨ (t_2)", ("a",): "(t_3)"}
    assert collected(p.lookup(k=None)) == {(None,): "(t_1) ∨ (t_2)"}
    assert collected(p.msum(p)) == collected(p)


def test_anti_and_outer_and_sets(spark):
    r, s = legs(spark, NX), stops(spark, NX).where("no = 3")
    assert collected(r.anti(s, [("stop", "no")])) == {("red", 1): "l1", ("green", 5): "l4"}
    assert collected(r.anti(s, "stop > no")) == {("red", 1): "l1", ("red", 3): "l2", ("blue", 3): "l3"}
    assert collected(r.anti(s, [("stop", "no")], where="place = 'mill'")) == collected(r)
    assert collected(r.anti(s, [("stop", "no")], where="line < place")) == {
        ("red", 1): "l1", ("red", 3): "l2", ("green", 5): "l4",
    }
    assert collected(r.anti(s, between=("stop", "no - 1", "no + 1", 2))) == {("red", 1): "l1", ("green", 5): "l4"}
    assert collected(r.left_outer(s, [("stop", "no")])) == {
        ("red", 1, None, None): "l1", ("red", 3, 3, "harbour"): "l2·p2", ("blue", 3, 3, "harbour"): "l3·p2", ("green", 5, None, None): "l4",
    }
    assert collected(r.left_outer(s, "stop > no")) == {
        ("red", 1, None, None): "l1", ("red", 3, None, None): "l2", ("blue", 3, None, None): "l3", ("green", 5, 3, "harbour"): "l4·p2",
    }
    assert collected(r.left_outer(s, between=("stop", "no + 1", "no + 9", 4))) == collected(r.left_outer(s, "stop > no"))
    n = lambda rows: frame(spark, N, "k string", [((k,), {(): c}) for k, c in rows])
    a, b = n([("x", 5), ("y", 2), (None, 3)]), n([("x", 2), ("y", 4), (None, 1)])
    assert collected(a.minus(b)) == {("x",): 3, (None,): 2}
    assert collected(a.intersect(b)) == {("x",): 10, ("y",): 8, (None,): 3}
    p, q = legs(spark, NX).project("stop"), legs(spark, NX, ("u1", "u2", "u3", "u4")).project("stop").where("stop <= 3")
    assert collected(p.intersect(q)) == {(1,): "l1·u1", (3,): "l2·u2 + l2·u3 + l3·u2 + l3·u3"}
    for op in (lambda: p.minus(q), lambda: p.divide(q)):
        with pytest.raises(ValueError):
            op()


def test_division(spark):
    b = lambda rows, schema: annotate(spark.createDataFrame(rows, schema), B)
    r = b([("a", 1), ("a", 2), ("b", 1), ("a", 1)], "x string, y int")
    assert set(collected(r.divide(b([(1,), (2,), (2,)], "y int")))) == {("a",)}
    assert set(collected(r.divide(b([(1,)], "y int")))) == {("a",), ("b",)}
    assert set(collected(r.divide(b([(1,)], "y int").where("false")))) == {("a",), ("b",)}


def test_grouping(spark):
    rows = [(("x", 2), {(): 3}), (("x", None), {(): 2}), (("y", 5), {(): 1})]
    aggs = dict(rows=("COUNT", "*"), known=("COUNT", "v"), total=("SUM", "v"), mean=("AVG", "v"), low=("MIN", "v"), high=("MAX", "v"))
    got = frame(spark, N, "k string, v int", rows).group(["k"], **aggs).support().collect()
    assert {tuple(float(c) if not isinstance(c, str) else c for c in r) for r in got} == {
        ("x", 5.0, 3.0, 6.0, 2.0, 2.0, 2.0), ("y", 1.0, 1.0, 5.0, 5.0, 5.0, 5.0),
    }
    r = legs(spark, NX).group(["line"], calls=("COUNT", "stop"), top=("MAX", "stop"))
    assert collected(r) == {("red", 2, 3): "l1 + l2", ("blue", 1, 3): "l3", ("green", 1, 5): "l4"}
    with pytest.raises(ValueError):
        legs(spark, NX).group(["line"], x=("MEDIAN", "stop"))
    plain = annotate(spark.createDataFrame([("x", 1), ("x", 1), ("x", 2)], "k string, v int"), N)
    totals = [f.group(["k"], c=("COUNT", "v"), s=("SUM", "v"), m=("AVG", "v")).support() for f in (plain, plain.merge())]
    assert totals[0].dtypes == totals[1].dtypes == [("k", "string"), ("c", "bigint"), ("s", "bigint"), ("m", "double")]
    assert totals[0].collect() == totals[1].collect() == [("x", 3, 4, 4 / 3)]


def test_predicates(spark):
    parts = frame(
        spark, N, "p_partkey int, p_brand string, p_type string, p_size int",
        [
            ((128, "Brand#12", "MEDIUM POLISHED TIN", 5), {(): 1}),
            ((129, "Brand#45", "SMALL BRUSHED STEEL", 14), {(): 1}),
            ((256, "Brand#23", "MEDIUM ANODIZED BRASS", 49), {(): 1}),
            ((300, "Brand#12", "LARGE PLATED NICKEL", 7), {(): 1}),
            ((301, "Brand#45", "STANDARD BURNISHED COPPER", 30), {(): 1}),
        ],
    )
    for predicate, rows in {
        "p_size IN (5, 14, 49)": 3,
        "p_size NOT IN (5, 14, 49)": 2,
        "p_type LIKE 'MEDIUM%'": 2,
        "p_type NOT LIKE 'MEDIUM%'": 3,
        "p_size BETWEEN 5 AND 14": 3,
        "p_partkey % 128 = 0": 2,
        "p_partkey % 3 = -(-p_partkey % 3)": 5,
        "NOT p_size > 14 AND p_brand = 'Brand#12'": 2,
        "'Brand#12' = p_brand": 2,
        "1 = 1": 5,
        "1 = 2": 0,
        "p_size = '14'": 1,
        "try_cast(p_brand AS INT) = 1": 0,
        "p_size = NULL": 0,
        "p_size <=> NULL": 0,
        "p_type LIKE concat('%', substr(p_type, 2))": 5,
    }.items():
        assert parts.where(predicate).support_size() == rows, predicate
    assert parts.where(F.col("p_size") > 20).support_size() == 2
    assert parts.where(lambda row: row["p_size"] ** 2 > 600).support_size() == 2


def test_python_predicate_sees_none(spark):
    r = annotate(spark.createDataFrame([(None, 1), ("a", None)], "k string, n int"), B)
    assert set(collected(r.where(lambda row: row["k"] is None and row["n"] == 1))) == {(None, 1)}


@pytest.mark.parametrize(
    "expr, want",
    [
        ("DATE '1994-01-01' + INTERVAL '1' YEAR", "1995-01-01"),
        ("DATE '1993-10-01' + INTERVAL '3' MONTH", "1994-01-01"),
        ("DATE '1994-01-01' + INTERVAL '10' DAY", "1994-01-11"),
        ("DATE '1995-01-01' - INTERVAL '1' YEAR", "1994-01-01"),
        ("DATE '1994-11-01' + INTERVAL '3' MONTH", "1995-02-01"),
        ("DATE '1996-02-29' + INTERVAL '1' YEAR", "1997-02-28"),
        ("DATE '1996-01-31' + INTERVAL '1' MONTH", "1996-02-29"),
    ],
)
def test_date_intervals(spark, expr, want):
    df = spark.createDataFrame([(datetime.date.fromisoformat(want),)], "d date")
    assert annotate(df, N).where(f"d = {expr}").support_size() == 1


def test_published_sizes_of_single_operators(spark):
    """Exact clause and literal counts of the small per-operator workloads."""

    def rel(prefix, schema, rows):
        return frame(spark, BX, schema, [(r, v(f"{prefix}{i}")) for i, r in enumerate(rows)])

    def wide(prefix, schema, row, width):
        return frame(spark, BX, schema, [(row, {(f"{prefix}{i}",): 1 for i in range(width)})])

    def sizes(f):
        return tuple(f.total_stats().first())

    ten = [(i, f"v{i}") for i in range(10)]
    schema = "id int, val string"
    assert sizes(rel("a", schema, ten).where("id % 2 = 0")) == (5, 5, 5)
    assert sizes(rel("a", schema, ten).project("id", "val")) == (10, 10, 10)
    left, right = rel("l", "a int", [(i,) for i in range(5)]), rel("r", "b int", [(i,) for i in range(10)])
    assert sizes(left.cross(right)) == (50, 50, 100)
    assert sizes(rel("a", schema, ten).msum(rel("b", schema, ten))) == (10, 20, 20)
    assert sizes(rel("a", schema, ten).dedup(EXISTS)) == (10, 10, 0)
    grid = rel("p", "k string, x int", [("K", i) for i in range(256)])
    assert sizes(grid.project("k")) == (1, 256, 256)
    assert sizes(wide("wa", "k string", ("K",), 48).msum(wide("wb", "k string", ("K",), 48))) == (1, 96, 96)
    dense = rel("x", "a int", [(i,) for i in range(48)]).cross(rel("y", "b int", [(i,) for i in range(48)]))
    assert sizes(dense) == (2304, 2304, 4608)
    choke = wide("ma", "a string", ("A",), 48).cross(wide("mb", "b string", ("B",), 48))
    assert sizes(choke) == (1, 2304, 4608)
    eight = [((i,), {(f"w{i}_{k}",): 1 for k in range(48)}) for i in range(8)]
    wides, grid8 = frame(spark, BX, "a int", eight), rel("gr", "b int", [(i,) for i in range(8)])
    assert sizes(wides.dedup(EXISTS).cross(grid8)) == (64, 64, 64)
    assert sizes(wides.dedup(HOW).cross(grid8)) == (64, 3072, 6144)


@pytest.mark.parametrize("semiring", SEMIRINGS, ids=IDS)
def test_comparing_relations(spark, semiring):
    r, s = legs(spark, semiring), stops(spark, semiring)
    t = stops(spark, semiring, ("p7", "p8", "p9"))
    assert r.cross(s.msum(t)).equals(r.cross(s).msum(r.cross(t)))
    assert not r.equals(r.where("stop = 3"))
    assert r.equals(r.msum(r)) == (semiring.name in ("B", "B[X]"))
    gone = r.differences(r.where("stop < 5")).collect()
    assert [(x["line"], x["stop"], x["side"]) for x in gone] == [("green", 5, 1)]


def test_alias_with_a_dot(spark):
    r = legs(spark, NX)
    q = r.alias("a", ".").cross(r.alias("b", ".")).where("`a.stop` < `b.stop` AND `b.stop` < 5").project("a.line", "b.line")
    assert collected(q) == {("red", "red"): "l1·l2", ("red", "blue"): "l1·l3"}
