"""CSV with a two-line header: type hints, column names, then data; empty means NULL.

A table is ``<dir>/<table>.csv``, one file or a folder of parts that each start
with both header lines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provframe.frame import KFrame
from provframe.semirings import Semiring
from provframe.sources.annotate import annotate
from provframe.sources.tables import ROW_IDS, SCHEMAS, SPARK_TYPES, capped, hints

#: Type of numbers with the hint DECIMAL unless another is given.
DECIMAL = "decimal(38,18)"

READ_OPTIONS = {
    "header": "true",
    "enforceSchema": "true",
    "quote": '"',
    "escape": '"',
    "mode": "FAILFAST",
}
WRITE_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_header(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """[(column, hint)] from the first two lines of the file (or of one part)."""
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").head(2)
    if len(lines) < 2:
        raise ValueError(f"{path} has no two-line header")
    types, names = (line["value"].strip().split(",") for line in lines)
    if len(types) != len(names) or not set(types) <= set(SPARK_TYPES):
        raise ValueError(f"{path} does not start with type hints and column names")
    return list(zip(names, types))


def read_typed_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[tuple[str, str]] | None = None,
    multiline: bool = False,
    decimal: str = DECIMAL,
) -> DataFrame:
    """Typed DataFrame of one table; ``columns`` defaults to what the header says.

    Spark drops the first line of every file, the second is dropped by its place, so a data
    row that spells like it stays. Numbers with the hint DECIMAL become ``decimal``; digits
    that don't fit raise. ``multiline`` allows line breaks inside quotes, at the price of reading each
    part in one task.
    """
    columns = list(columns) if columns is not None else read_header(spark, path)
    names = [c for c, _ in columns]
    raw = T.StructType([T.StructField(c, T.StringType()) for c in names])
    df = spark.read.options(**READ_OPTIONS, multiLine=str(multiline).lower()).schema(raw).csv(path)
    at = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    df = df.select(*[F.col(f"`{c}`") for c in names], *at).mapInArrow(_without_names_line, raw)
    return df.select(*[_typed(c, h, decimal).alias(c) for c, h in columns])


def _without_names_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the first row of each file's first block. Rows of a block come together and in order."""
    last = None
    for batch in batches:
        files, starts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        keep = []
        for place in zip(files.to_pylist(), starts.to_pylist()):
            keep.append(place == last or place[1] != 0)
            last = place
        rows = pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2])
        yield rows.filter(pa.array(keep, pa.bool_()))


def _typed(name: str, hint: str, decimal: str) -> Column:
    text = F.nullif(F.col(f"`{name}`"), F.lit(""))
    if hint == "STR":
        return text
    if hint != "DECIMAL":
        return text.cast(SPARK_TYPES[hint])
    scale = T.StructType.fromDDL(f"x {decimal}")["x"].dataType.scale
    lost = text.rlike(rf"\.[0-9]{{{scale}}}[0-9]*[1-9]")
    refuse = F.raise_error(F.concat(F.lit(f"more digits than {decimal} holds: "), text)).cast(decimal)
    return F.when(lost, refuse).otherwise(text.cast(decimal))


def load_csv(
    spark: SparkSession,
    csv_dir: str,
    semiring: Semiring,
    tables: Iterable[str] | None = None,
    limit: int | None = None,
    ids: Mapping[str, Sequence[str]] | None = None,
    multiline: bool = False,
    decimal: str = DECIMAL,
) -> dict[str, KFrame]:
    """Annotated relations of the tables found in ``csv_dir``, with the columns their headers name.

    Missing tables are skipped; none at all is a ``FileNotFoundError``; unknown tables and
    columns raise. Rows get the constant one unless ``ids`` names the columns of a table's variables.
    """
    names = [t.lower() for t in tables] if tables is not None else list(SCHEMAS)
    out: dict[str, KFrame] = {}
    for t in names:
        known = dict(hints(t))
        path = f"{csv_dir.rstrip('/')}/{t}.csv"
        try:
            columns = read_header(spark, path)
            unknown = [c for c, _ in columns if c not in known]
            if unknown:
                raise ValueError(f"{path} has unknown column(s) {unknown}")
            df = read_typed_csv(spark, path, columns, multiline, decimal)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        row_ids = (ids or {}).get(t)
        df = capped(df, limit, [c for c in row_ids or ROW_IDS[t] if c in df.columns])
        out[t] = annotate(df, semiring, t if row_ids else None, row_ids)
    if not out:
        raise FileNotFoundError(f"no known table as CSV in {csv_dir}")
    return out


def _hint_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "INT"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DATE"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "DECIMAL"
    return "STR"


def _written(name: str, hint: str, dtype: T.DataType | None = None) -> Column:
    c = F.col("`" + name + "`")
    if hint == "INT":
        return c.cast("bigint").cast("string")
    if hint == "DATE" and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        # A column of days has no place for a time of day.
        refuse = F.raise_error(F.concat(F.lit("time of day in a DATE column: "), c.cast("string")))
        return F.when(c.isNull() | (c == F.date_trunc("day", c).cast(dtype)), c.cast("date").cast("string")).otherwise(refuse)
    return c.cast("string")


def write_typed_csv(
    df: DataFrame, path: str, columns: Sequence[tuple[str, str]] | None = None
) -> None:
    """Write ``df`` as a folder of parts, each with the two header lines.

    Rows become CSV lines inside the JVM; Python only puts the header in front
    of each partition's Arrow batches.
    """
    columns = list(columns) if columns is not None else [
        (f.name, _hint_of(f.dataType)) for f in df.schema.fields
    ]
    types = {f.name: f.dataType for f in df.schema.fields}
    line = F.to_csv(F.struct(*[_written(c, h, types[c]).alias(c) for c, h in columns]), WRITE_OPTIONS)
    if len(columns) == 1:  # an empty line would be skipped by readers
        only = _written(*columns[0], types[columns[0][0]])
        line = F.when(F.coalesce(only, F.lit("")) == "", F.lit('""')).otherwise(line)
    header = [",".join(h for _, h in columns), ",".join(c for c, _ in columns)]

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(header, pa.string())], ["value"])
        yield from batches

    df.select(line.alias("value")).mapInArrow(with_header, "value string").write.mode(
        "overwrite"
    ).text(path)


def write_tables(
    spark: SparkSession,
    frames: Mapping[str, DataFrame],
    csv_dir: str,
    limit: int | None = None,
) -> list[str]:
    """Write known tables as typed CSV with the columns they have; returns their names."""
    written = []
    for t, df in frames.items():
        known = [(c, h) for c, h in hints(t) if c in df.columns]
        order = [c for c in ROW_IDS[t] if c in df.columns]
        write_typed_csv(capped(df, limit, order), f"{csv_dir.rstrip('/')}/{t}.csv", known)
        written.append(t)
    return written
