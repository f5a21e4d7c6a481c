"""Text, packed form, parts of large formulas, statistics, lookups."""

import hashlib

import pytest
from pyspark.sql import functions as F

from provframe import BX, NX, B, Dedup, N, annotate

from . import brute
from .helpers import frame


def numbers(spark, s, n=500):
    """Tuple 'hot' with n-2 rows, two small tuples."""
    df = spark.range(n).select(
        F.when(F.col("id") == 0, "a").when(F.col("id") == 1, F.lit(None)).otherwise("hot").alias("k"), "id"
    )
    return annotate(df, s, "t", ["id"], keep=["k"])


@pytest.mark.parametrize("semiring", [BX, NX], ids=["B[X]", "N[X]"])
@pytest.mark.parametrize("merged", [False, True])
def test_parts_in_order_are_the_canonical_text(spark, semiring, merged):
    f = numbers(spark, semiring).project("k")
    f = f.merge() if merged else f
    whole = {r["k"]: r["annotation"] for r in f.text().collect()}
    glue = " ∨ " if semiring is BX else " + "
    parts = {}
    for r in f.text(max_terms=50).collect():
        parts.setdefault(r["k"], {})[r["part"]] = r["annotation"]
    assert {k: sorted(p) for k, p in parts.items()} == {"a": [0], None: [0], "hot": list(range(10))}
    assert {k: glue.join(p[i] for i in sorted(p)) for k, p in parts.items()} == whole
    assert [len(parts["hot"][i].split(glue)) for i in range(10)] == [50] * 9 + [48]
    terms = whole["hot"].split(glue)
    assert terms == sorted(terms, key=lambda t: t.encode())


def test_rows_move_twice_for_a_text(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = numbers(spark, BX).project("k").text()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # dealt by stretch (once more planned for the counts, which reuse it), counts by tuple and back, dealt by part
    assert plan.count("Exchange hashpartitioning") <= 5


def items_by_order(spark, s, hot=120):
    """Orders joined with their items: order 0 has ``hot`` items, the others three, one of which comes twice."""
    orders = spark.range(40).select(F.col("id").alias("o"), F.when(F.col("id") % 2 == 0, "even").alias("name"))
    few = spark.range(160).select((F.col("id") % 40).alias("lo"), F.when(F.col("id") < 40, F.col("id") + 40).otherwise(F.col("id")).alias("item")).where("lo > 0")
    items = few.union(spark.range(hot).selectExpr("0 AS lo", "id + 1000 AS item"))
    return annotate(orders, s, "o", ["o"]).join(annotate(items, s, "i", ["lo", "item"]), [("o", "lo")]).project("name", "o")


@pytest.mark.parametrize("semiring", [BX, NX], ids=["B[X]", "N[X]"])
def test_tuples_of_few_terms_do_not_move_again(spark, semiring):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = items_by_order(spark, semiring).text()
        rows = {(r["name"], r["o"], r["part"]): r["annotation"] for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moves = [line for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning" in line]
    assert moves and not [m for m in moves if "__key" in m or "__stretch" in m or "__order" in m]
    assert len(rows) == 40 and rows[(None, 7, 0)] == (
        "(i_7_127 ∧ o_7) ∨ (i_7_47 ∧ o_7) ∨ (i_7_87 ∧ o_7)" if semiring is BX else "i_7_127·o_7 + 2·i_7_47·o_7 + i_7_87·o_7"
    )


@pytest.mark.parametrize("semiring", [BX, NX], ids=["B[X]", "N[X]"])
@pytest.mark.parametrize("merged", [False, True])
def test_tuples_of_few_and_of_many_terms(spark, semiring, merged):
    f = items_by_order(spark, semiring)
    f = f.merge() if merged else f
    rows = lambda df: sorted((r["name"] or "", r["o"], r["part"], r["annotation"]) for r in df.collect())
    found = rows(f.text(max_terms=50))
    assert [r[2] for r in found if r[1] == 0] == [0, 1, 2] and len(found) == 42
    assert found == rows(f.text(max_terms=50, spread=True))
    sizes = {(r[1], r[2]): len(r[3]) for r in rows(f.packed(max_terms=50))}
    assert sizes == {(0, 0): 50, (0, 1): 50, (0, 2): 20} | {(o, 0): 3 for o in range(1, 40)}


def test_result_names_that_are_attributes(spark):
    f = annotate(spark.createDataFrame([(1, 2, 3, 4)], "part int, term int, n int, annotation int"), BX, "t", ["n"])
    for make in (f.text, f.packed, f.terms):
        with pytest.raises(ValueError, match="attributes too"):
            make()
    assert f.text(name="formula", part="piece").columns == ["part", "term", "n", "annotation", "piece", "formula"]
    with pytest.raises(ValueError, match="attributes too"):
        annotate(f.df.select("n"), N).result()
    assert annotate(f.df.select("n"), N).result("times").columns == ["n", "times"]


def test_packed_forms(spark):
    p = brute.add(brute.mul(brute.var("x"), brute.var("x")), brute.add(brute.var("y"), brute.var("y")))
    row = frame(spark, NX, "k int", [((1,), p)]).packed().first()
    assert [([(v["v"], v["e"]) for v in t["m"]], int(t["c"])) for t in row["annotation"]] == [
        ([("x", 2)], 1), ([("y", 1)], 2),
    ]
    assert frame(spark, BX, "k int", [((1,), p)]).packed().first()["annotation"] == [["x"], ["y"]]
    assert int(frame(spark, N, "k int", [((1,), p)]).packed().first()["annotation"]) == 3
    assert frame(spark, B, "k int", [((1,), p)]).packed().first()["annotation"] is True


def test_constants(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert {tuple(r) for r in annotate(df, BX).text().collect()} == {(1, 0, "True"), (2, 0, "True")}
    assert {tuple(r) for r in annotate(df, NX).text().collect()} == {(1, 0, "2"), (2, 0, "1")}
    p = brute.add(brute.one(), brute.add(brute.one(), brute.var("x")))
    assert frame(spark, NX, "k int", [((1,), p)]).text().first()["annotation"] == "2 + x"
    assert frame(spark, BX, "k int", [((1,), p)]).text().first()["annotation"] == "True"


def test_stats_and_digest(spark):
    f = numbers(spark, BX).project("k")
    rows = {r["k"]: r for r in f.stats(digest=True).collect()}
    assert (rows["hot"]["clauses"], rows["hot"]["literals"]) == (498, 498)
    want = sum(int(hashlib.md5(f"(t_{i})".encode()).hexdigest()[:8], 16) for i in range(2, 500))
    assert rows["hot"]["digest"] == want
    assert tuple(f.total_stats().first()) == (3, 500, 500)
    assert tuple(f.where("false").total_stats().first()) == (0, 0, 0)


def test_variables_and_one_witness(spark):
    p = brute.add(brute.mul(brute.var("x"), brute.var("y")), brute.mul(brute.var("a"), brute.var("z")))
    for s in (BX, NX):
        f = frame(spark, s, "k int", [((1,), p), ((2,), brute.one())])
        assert {tuple(r) for r in f.variables().collect()} == {(1, v) for v in "axyz"}
    one = frame(spark, NX, "k int", [((1,), brute.add(p, p)), ((2,), brute.one())]).one_witness()
    assert {tuple(r) for r in one.text().collect()} == {(1, 0, "a·z"), (2, 0, "1")}


def test_absent_leaves(spark):
    """A sum of branches with different tables: each term names only its own rows."""
    t = lambda name: annotate(spark.createDataFrame([(1,)], "k int"), NX, name, ["k"])
    both = t("a").join(t("b").rename({"k": "k2"}), [("k", "k2")]).project("k")
    f = both.msum(t("c")).msum(t("a").dedup(Dedup.EXISTENCE)).msum(t("b"))
    assert f.text().first()["annotation"] == "1 + a_1·b_1 + b_1 + c_1"
    assert tuple(f.stats().first()) == (1, 4, 4, 4)


def test_variable_names(spark):
    df = spark.createDataFrame([("a_b", "c", None), ("a", "b_c", 1)], "x string, y string, n int")
    f = annotate(df, BX, "t", ["x", "y", "n"], keep=["n"])
    names = {r["variable"] for r in f.variables().collect()}
    assert names == {"t_a\\_b_c_\\N", "t_a_b\\_c_1"}


def test_default_identifiers_tell_rows_apart(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, None)], "a int, b int")
    f = annotate(df, NX, "t")
    assert {(r["a"], r["terms"], r["coefficients"]) for r in f.stats().collect()} == {(1, 1, 2), (None, 1, 1)}
    assert f.variables().count() == 2


def test_unique_identifiers_need_no_merge(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    for s in (BX, NX):
        plan = (
            annotate(df, s, "t", ["id"], unique=True).project("k").merge().df
            ._jdf.queryExecution().executedPlan().toString()
        )
        assert "Exchange" not in plan
    f = annotate(df, NX, "t", ["id"], unique=True)
    pairs = f.alias("a").join(f.alias("b"), [("a_k", "b_k")]).project("a_k")
    assert {tuple(r) for r in pairs.stats().collect()} == {(0, 15, 25, 50 - 20), (1, 15, 25, 30)}


def test_scalar_and_symbolic_results_are_not_mixed_up(spark):
    with pytest.raises(ValueError):
        numbers(spark, BX).result()
    with pytest.raises(ValueError):
        annotate(spark.range(2), N).text()
