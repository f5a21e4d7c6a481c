"""Exact deduplication by progressive refinement: length, then a hash of a prefix, then a hash of the whole.

A first scan looks only at the length of the normalised text and a hash of its first characters. Lengths and then
(length, prefix) groups with one row are settled there. What remains goes into a bitmap of fixed size, one bit
for a hash of (length, prefix), with which a second scan decides, row by row and without moving any text,
whose content it has to hash in full. A false hit in the bitmap costs one more hash and changes nothing:
groups are formed on length, prefix hash and full hash together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provframe.llm.common import materialize

PREFIX_CHARS = 256
#: Bits of the bitmap: a multiple of 32,768. The broadcast is at most an eighth of it in bytes, whatever the input.
FILTER_BITS = 1 << 24
PER_BITMAP = 32768
#: The characters that don't count.
IGNORED = (" ", "\t", "\n", "\v", "\f", "\r")


def normalised(text: Column) -> Column:
    """The text without the ignored characters; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _slot(bits: int) -> Column:
    return F.pmod(F.xxhash64("norm_len", "prefix"), F.lit(bits))


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[byte.bitwiseAND(F.lit(1 << k)) for k in range(8)]), F.pmod(position, F.lit(8)).cast("int")) != 0


def _refined(rows: DataFrame, filter_bits: int) -> DataFrame:
    """``rows`` with ``alive``: whether their length and prefix hash leave open if another row has their text."""
    cheap = rows.groupBy("norm_len", "prefix").agg(F.count(F.lit(1)).alias("n"))
    lengths = cheap.groupBy("norm_len").agg(F.sum("n").alias("of_length")).where("of_length > 1").select("norm_len")
    survive = cheap.where("n > 1").join(lengths, "norm_len", "left_semi").withColumn("slot", _slot(filter_bits))
    bitmaps = survive.groupBy(F.floor(F.col("slot") / PER_BITMAP).alias("map")).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(PER_BITMAP))).alias("bits"))
    bitmaps = F.broadcast(materialize(bitmaps, "length-prefix-bitmaps"))  # filter_bits / PER_BITMAP rows of 4 KB at most

    rows = rows.withColumn("slot", _slot(filter_bits)).withColumn("map", F.floor(F.col("slot") / PER_BITMAP)).join(bitmaps, "map", "left")
    return rows.withColumn("alive", F.coalesce(_bit(F.col("bits"), F.pmod("slot", F.lit(PER_BITMAP))), F.lit(False)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space; of equal texts the row with the most code points
    stays, then the smallest id, nulls last. Null counts as empty and equals other empty texts. Repeated rows (same id, same
    text) count in group_size and one of them stays. ``text_sha256`` is null for rows that the first two
    steps settled, unless ``digest_all`` asks for it everywhere. An empty table gives no row; other columns of
    ``docs`` are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"), normalised(F.col(text_col)).alias("norm")
    ).select("doc_id", "chars", "norm", F.char_length("norm").alias("norm_len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"))

    rows = _refined(rows, filter_bits)
    hashed = rows.select("doc_id", "chars", "norm_len", "prefix", "alive", F.when(F.col("alive") | F.lit(digest_all), F.sha2("norm", 256)).alias("text_sha256"))

    # Repeated rows become one row with a count before anything is compared.
    hashed = hashed.groupBy("doc_id", "chars", "norm_len", "prefix", "alive", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    hashed = materialize(hashed, "hashed")
    key = ["norm_len", "prefix", "text_sha256"]
    # A null id comes last: it stays only if no other row of the group has as many code points.
    order = F.struct(-F.col("chars"), F.col("doc_id").isNull(), "doc_id")
    best = hashed.where("alive").groupBy(*key).agg(F.min(order).alias("best"), F.sum("copies").alias("group_size"))
    best = best.select(*key, F.col("best.doc_id").alias("keep_id"), (-F.col("best.col1")).alias("keep_chars"), "group_size")
    grouped = hashed.where("alive").join(best, key)
    alone = hashed.where("NOT alive").select("*", F.col("doc_id").alias("keep_id"), F.col("chars").alias("keep_chars"), F.col("copies").alias("group_size"))
    found = grouped.select(alone.columns).union(alone)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return found.select("doc_id", "keep_id", "group_size", "text_sha256", stays.alias("stays"), copy).select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one that ``exact_groups`` keeps.

    Rows that length or prefix settle stay where they are read; only the others are hashed in full and compared. Null counts as empty
    and equals other empty texts; ids may be null; of rows repeated in id and text one stays, the first by their other columns'
    hash. An empty table gives no row. Columns may have any name. The choice is the first rank of a window, which Spark cuts
    down to one row of a group in each task before the shuffle, so a group of very many copies does not meet whole.
    """
    row = docs.select(F.struct("*").alias("row"))
    text = F.col(f"row.{text_col}")
    norm = normalised(text)
    rows = _refined(row.select("row", F.char_length(norm).alias("norm_len"), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix")), filter_bits)
    open_rows = rows.where("alive").withColumn("sha", F.sha2(norm, 256))
    chars, key = F.char_length(F.coalesce(text, F.lit(""))), F.col(f"row.{id_col}")
    first = Window.partitionBy("norm_len", "prefix", "sha").orderBy(chars.desc(), key.asc_nulls_last(), text, F.xxhash64(F.to_json("row")))
    best = open_rows.withColumn("rank", F.row_number().over(first)).where("rank = 1")
    return rows.where("NOT alive").select("row.*").unionAll(best.select("row.*"))
