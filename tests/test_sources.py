"""Annotating at load, typed CSV, tables."""

import datetime
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from provframe import BX, B, N, annotate, from_terms
from provframe.sources.tables import SCHEMAS, hints, load_tables, read_table, struct_type
from provframe.sources.typed_csv import load_csv, read_header, read_typed_csv, write_tables, write_typed_csv

from .conftest import SF_SMALL
from .helpers import collected

NATION = "INT,STR,INT,STR\nn_nationkey,n_name,n_regionkey,n_comment\n0,ALGERIA,0,\"one, \"\"two\"\"\"\n1,,1,\n"


def write(path, text):
    path.write_text(text, encoding="utf-8")


def test_hand_written_file(spark, tmp_path):
    write(tmp_path / "nation.csv", NATION)
    write(tmp_path / "region.csv", "INT,STR,STR\nr_regionkey,r_name,r_comment\n0,AFRICA,\n")
    t = load_csv(spark, str(tmp_path), N)
    assert set(t) == {"nation", "region"}
    assert collected(t["nation"]) == {(0, "ALGERIA", 0, 'one, "two"'): 1, (1, None, 1, None): 1}
    assert collected(load_csv(spark, str(tmp_path), BX, ["NATION"], ids={"nation": ["n_nationkey"]})["nation"].project("n_regionkey")) == {
        (0,): "(nation_0)", (1,): "(nation_1)",
    }
    assert load_csv(spark, str(tmp_path), N, ["nation"], limit=1)["nation"].support_size() == 1
    assert read_header(spark, str(tmp_path / "nation.csv"))[0] == ("n_nationkey", "INT")


def test_missing_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_csv(spark, str(tmp_path), N)
    with pytest.raises(FileNotFoundError):
        load_csv(spark, str(tmp_path / "nowhere"), N)
    with pytest.raises(ValueError, match="unknown table"):
        hints("nope")
    with pytest.raises(ValueError, match="unknown table"):
        load_tables(spark, SF_SMALL, N, ["nope"])


def test_malformed_number_raises(spark, tmp_path):
    write(tmp_path / "region.csv", "INT,STR,STR\nr_regionkey,r_name,r_comment\nx1,AFRICA,\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_csv(spark, str(tmp_path), N)["region"].support_size()


def test_round_trip_of_awkward_values(spark, tmp_path):
    rows = [
        (1, 'a,"b"', datetime.date(1996, 2, 29), Decimal("-1.50")),
        (None, None, None, None),
        (3, " padded ", datetime.date(1, 1, 1), Decimal("0.00")),
        (4, "back\\slash", None, Decimal("99999999999.99")),
        (5, "two\nlines", None, None),
        (6, "ünï ∧ #hash", None, None),
    ]
    df = spark.createDataFrame(rows, "i bigint, s string, d date, n decimal(15,2)").repartition(3)
    path = str(tmp_path / "t.csv")
    write_typed_csv(df, path)
    parts = [p for p in os.listdir(path) if p.startswith("part-")]
    assert all(
        (tmp_path / "t.csv" / p).read_text(encoding="utf-8").startswith("INT,STR,DATE,DECIMAL\ni,s,d,n\n") for p in parts
    )
    back = read_typed_csv(spark, path, multiline=True)
    assert back.schema.simpleString() == "struct<i:bigint,s:string,d:date,n:decimal(38,18)>"
    assert {tuple(r) for r in back.collect()} == set(rows)


def test_nothing_is_lost(spark, tmp_path):
    path = str(tmp_path / "n.csv")
    exact = Decimal("0.123456789012345678")
    df = spark.createDataFrame([("s", exact), ("x", Decimal("1.5"))], "s string, n decimal(38,18)")
    write_typed_csv(df, path)
    assert {tuple(r) for r in read_typed_csv(spark, path).collect()} == {("s", exact), ("x", Decimal("1.5"))}
    with pytest.raises(Exception, match="more digits"):
        read_typed_csv(spark, path, decimal="decimal(15,2)").collect()
    names = str(tmp_path / "names.csv")
    write_typed_csv(spark.createDataFrame([("s",), ("t",), ("s",)], "s string").repartition(2), names)
    assert sorted(r[0] for r in read_typed_csv(spark, names).collect()) == ["s", "s", "t"]
    with pytest.raises(Exception, match="time of day"):
        write_typed_csv(spark.sql("SELECT TIMESTAMP '2020-01-02 03:04:05' AS d"), str(tmp_path / "d.csv"))


def test_tables_are_loaded_as_written(spark, tmp_path):
    frames = {t: read_table(spark, SF_SMALL, t) for t in ("region", "nation", "orders")}
    write_tables(spark, frames, str(tmp_path))
    back = load_csv(spark, str(tmp_path), N)
    assert {t: f.columns for t, f in back.items()} == {t: df.columns for t, df in frames.items()}
    assert back["orders"].df.count() == frames["orders"].count()
    with pytest.raises(ValueError, match="unknown table"):
        load_csv(spark, str(tmp_path), N, ["nope"])
    write(tmp_path / "region.csv.txt", "")
    write_typed_csv(spark.createDataFrame([(1,)], "other bigint"), str(tmp_path / "part.csv"))
    with pytest.raises(ValueError, match="unknown column"):
        load_csv(spark, str(tmp_path), N, ["part"])


def test_single_column_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    write_typed_csv(spark.createDataFrame([("a",), (None,)], "s string"), path)
    assert {r[0] for r in read_typed_csv(spark, path).collect()} == {"a", None}
    empty = str(tmp_path / "empty.csv")
    write_typed_csv(spark.createDataFrame([], "i bigint, s string"), empty)
    assert read_typed_csv(spark, empty, [("i", "INT"), ("s", "STR")]).count() == 0


def test_tables_round_trip(spark, tmp_path):
    names = ["region", "nation", "supplier", "orders"]
    frames = {t: read_table(spark, SF_SMALL, t) for t in names}
    assert write_tables(spark, frames, str(tmp_path)) == names
    for t in names:
        back = read_typed_csv(spark, str(tmp_path / f"{t}.csv"))
        want = read_table(spark, SF_SMALL, t, conform=True)
        want = want.select(*[F.col(c).cast("decimal(38,18)").alias(c) if k.startswith("decimal") else F.col(c) for c, k in want.dtypes])
        assert back.columns == want.columns
        assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0


def test_loading_tables(spark):
    t = load_tables(spark, SF_SMALL, N)
    assert set(t) == set(SCHEMAS) - {"partsupp"}
    assert load_tables(spark, SF_SMALL, N, ["Nation"], limit=3)["nation"].support_size() == 3
    assert len(struct_type("lineitem")) == 16
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_tables(spark, SF_SMALL, N, ["partsupp"])


def test_equal_rows_are_one_tuple(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None)], "k int, s string")
    assert collected(annotate(df, N)) == {(1, "a"): 2, (2, None): 2}
    assert set(collected(annotate(df, B))) == {(1, "a"), (2, None)}
    assert collected(annotate(df, BX)) == {(1, "a"): "True", (2, None): "True"}


def test_given_annotations(spark):
    df = spark.createDataFrame([("a", 3, True), ("b", 0, False), ("a", 1, None)], "k string, w int, p boolean")
    assert collected(annotate(df, N, weight="w", keep=["k"])) == {("a",): 4}
    assert set(collected(annotate(df, B, present="p", keep=["k"]))) == {("a",)}
    for bad in (None, -1.0, 0.4):
        with pytest.raises(Exception, match="not an annotation"):
            annotate(spark.createDataFrame([("a", bad)], "k string, w double"), N, weight="w").result().collect()
    with pytest.raises(ValueError):
        annotate(df, B, weight="w")
    with pytest.raises(ValueError):
        annotate(df, BX, "t", ["missing"])
    with pytest.raises(ValueError):
        from_terms(df, N, "k")
