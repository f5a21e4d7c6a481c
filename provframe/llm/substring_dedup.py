"""Removal of passages that an earlier document has too, by external induced sorting of suffixes.

Sorting all suffixes of a corpus would move every byte many times. As in induced sorting, only sampled suffixes are sorted,
and the order of the others is induced from them:

1. Samples are local minima: the k-mers with the smallest hash within some ``length``-byte string. Every such string
   holds a sample that depends on its content alone, so equal strings hold equal samples at the same place. The first
   round of the recursion names samples by their k-mer and drops those whose name only one document has.
2. The remaining suffixes are carried as tuples (name, document, place, bytes around) through Spark's external sort, which
   spills to disk; each task gets its names in order. There the tuples of a name are sorted by suffix, with the
   common-prefix value of each neighbour.
3. The suffix that starts one byte earlier is induced: stable by that byte, in the order known so far; common-prefix values are one
   more than the least between the two in that order. ``length - k`` such steps reach every string with the
   sample in it. Where the values are at least ``length``, neighbours start with the same string, and all but
   those of the smallest document are marked.

Names that very many documents share don't meet in one task: a map task settles what it can see itself, and the strings
around samples with many members are dealt out one by one and pre-aggregated. Whole copies are settled by a hash first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provframe.llm.common import materialize, text_bytes
from provframe.llm.exact_dedup import FILTER_BITS, PER_BITMAP, _bit

LENGTH, KMER = 50, 20
LEFT = LENGTH - KMER
SPAN = LEFT + LENGTH
#: Bytes of text whose samples are sought at once, and members above which a name's strings are dealt out one by one.
PORTION, MANY = 2_000_000, 20_000
#: Bytes of text whose samples make a bucket of names, about; a task holds one bucket at a time.
BUCKET_BYTES = 8_000_000
#: Tuples that a task sorts at once, complete names only.
SORTED_AT_ONCE = 100_000
PLACE_BITS = 32
LAST = (1 << 63) - 1


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 20 bytes at every place of ``data`` that has as many after it."""
    n = len(data) - KMER + 1
    word = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = word[:n] * np.uint64(0x9E3779B185EBCA87)
    h ^= h >> np.uint64(29)
    h += word[8 : 8 + n]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h += word[12 : 12 + n] >> np.uint64(32)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h


def samples(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, name) of all samples of the texts; shorter texts than LENGTH have none."""
    empty = np.zeros(0, dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < LENGTH:
        return empty, empty, empty.view(np.uint64)
    names = _kmer_hashes(data)
    # Hash above, place below: values differ, and of equal hashes the first is the least.
    least = (names & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(names), dtype=np.uint64)
    width, reach = LENGTH - KMER + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    ends = np.cumsum(sizes)
    inside = np.zeros(len(least) + 1, dtype=np.int64)
    long = sizes >= LENGTH
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, (ends - LENGTH + 1)[long], -1)
    chosen = least[np.cumsum(inside[:-1]) > 0]
    place = (chosen & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    place = place[np.concatenate(([True], place[1:] != place[:-1]))] if len(place) else place
    owner = np.searchsorted(ends, place, "right")
    return owner, place - (ends - sizes)[owner], names[place]


def _shared(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by name, starts of names in it, whether a name has several documents, the number of each row's name."""
    order = np.lexsort((docs, names))
    names, docs = names[order], docs[order]
    starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(names))
    several = docs[starts] != docs[ends - 1] if len(names) else np.zeros(0, dtype=bool)
    return order, starts, several, np.repeat(np.arange(len(starts)), ends - starts)


FOUND = "bucket int, names binary, docs binary, keys binary, places binary"


def _batch(bucket: list[int], columns: list[list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", "names", "docs", "keys", "places"])


def _name_samples(buckets: int):
    """Rows of samples by bucket of their names. Bucket -1 - b holds samples already known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows, places, names, texts, first, size = [], [], [], [], 0, 0
            whole = text_bytes(batch.column(2))
            for k, text in enumerate(whole):
                texts.append(text)
                size += len(text)
                if size >= PORTION or k + 1 == len(whole):
                    owner, place, name = samples(texts)
                    rows.append(owner + first)
                    places.append(place)
                    names.append(name)
                    texts, first, size = [], k + 1, 0
            if not rows:
                continue
            row, place, name = np.concatenate(rows), np.concatenate(places), np.concatenate(names)
            order, starts, several, group = _shared(name, docs[row])
            known = several[group] if len(group) else np.zeros(0, dtype=bool)
            # Of a name that several of these documents share one entry goes on, without a place, for others to see.
            lone = np.concatenate((order[~known], order[starts[several]]))
            at = np.concatenate((place[order[~known]], np.full(int(several.sum()), -1, dtype=np.int64)))
            by = np.argsort(row[lone], kind="stable")
            out: list[tuple[int, np.ndarray, np.ndarray]] = [(0, lone[by], at[by]), (1, np.sort(order[known]), None)]
            bucket, columns = [], [[], [], [], []]
            for sign, index, own in out:
                own = place[index] if own is None else own
                deal = ((name[index] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets
                deal_order = np.argsort(deal, kind="stable")
                cuts = np.searchsorted(deal[deal_order], np.arange(buckets + 1))
                for b in range(buckets):
                    part = deal_order[cuts[b] : cuts[b + 1]]
                    if len(part):
                        bucket.append(-1 - b if sign else b)
                        for c, values in zip(columns, (name[index[part]], docs[row[index[part]]], keys[row[index[part]]], own[part].astype(np.int32))):
                            c.append(values.tobytes())
            yield _batch(bucket, columns)

    return run


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _shared_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text_key, places) of samples whose names several documents have. Rows come in order of their buckets, of which one is held."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = None

    def live(doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((place, key, doc))
        doc, key, place = doc[order], key[order], place[order].astype("<i4")
        cuts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))) if len(doc) else np.zeros(0, dtype=np.int64)
        ends = np.append(cuts[1:], len(doc))
        values = [place[a:b].tobytes() for a, b in zip(cuts, ends)]
        return pa.RecordBatch.from_arrays([pa.array(doc[cuts]), pa.array(key[cuts]), pa.array(values, pa.binary())], names=["doc", "text_key", "places"])

    def settle() -> pa.RecordBatch:
        name, doc, key, place = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        order, _, several, group = _shared(name, doc)
        hits = order[several[group]]
        hits = hits[place[hits] >= 0]
        return live(doc[hits], key[hits], place[hits])

    for batch in batches:
        buckets = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(buckets) else []
        for start, end in zip(starts, [*starts[1:], len(buckets)]):
            rows, bucket = batch.slice(start, end - start), int(buckets[start])
            if bucket < 0:
                yield live(_numbers(rows.column(2), "<i8"), _numbers(rows.column(3), "<i8"), _numbers(rows.column(4), "<i4"))
                continue
            if parts and bucket != held:
                yield settle()
            held = bucket
            parts.append((_numbers(rows.column(1), "<u8"), _numbers(rows.column(2), "<i8"), _numbers(rows.column(3), "<i8"), _numbers(rows.column(4), "<i4")))
    if parts:
        yield settle()


TUPLES = "name long, doc long, text_key long, place int, around binary, room int"


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tuple of each shared sample: LEFT bytes before it and LENGTH from it on, zeros beyond the text; room is what the text has after its place."""
    for batch in batches:
        docs, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for k, (text, lists) in enumerate(zip(text_bytes(batch.column(2)), batch.column(3).to_pylist())):
            place = np.unique(np.frombuffer(b"".join(lists), dtype="<i4")).astype(np.int64)
            for low in range(0, len(place), 20_000):
                at = place[low : low + 20_000]
                start = int(at[0]) - LEFT
                part = bytes(max(0, -start)) + text[max(0, start) : int(at[-1]) + LENGTH] + bytes(LENGTH)
                data = np.frombuffer(part, dtype=np.uint8)
                around = data[(at - at[0])[:, None] + np.arange(SPAN)[None, :]]
                names = _kmer_hashes(np.ascontiguousarray(data[LEFT:]))[at - at[0]]
                values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SPAN), len(at), [None, pa.py_buffer(around.tobytes())]).cast(pa.binary())
                n = len(at)
                columns = [pa.array(names.view(np.int64)), pa.array(np.full(n, docs[k])), pa.array(np.full(n, keys[k])), pa.array(at.astype(np.int32)), values, pa.array((len(text) - at).clip(max=LENGTH).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "doc", "text_key", "place", "around", "room"])


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high], both included, for many ranges: two overlapping powers of two each."""
    size = high - low + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    result = np.empty(len(low), dtype=values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            table = np.minimum(table[: len(table) - (1 << k - 1)], table[1 << k - 1 :])
        these = np.flatnonzero(level == k)
        result[these] = np.minimum(table[low[these]], table[high[these] - (1 << k) + 1])
    return result


def induced_marks(name: np.ndarray, doc: np.ndarray, place: np.ndarray, around: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For tuples with equal names together: which strings that start 0 to LEFT bytes before the sample a smaller document has."""
    m = len(name)
    marks = np.zeros((m, LEFT + 1), dtype=bool)
    group = np.cumsum(np.concatenate(([0], (name[1:] != name[:-1]).astype(np.int64))))
    # Suffixes of the samples themselves, by name and LENGTH bytes.
    keyed = np.concatenate((group.astype(">u4").view(np.uint8).reshape(m, 4), around[:, LEFT:]), axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{LENGTH + 4}").ravel(), kind="stable")
    ordered = around[order, LEFT:]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    common = np.concatenate(([0], np.where(group[order[1:]] == group[order[:-1]], common, 0))).astype(np.int64)
    for step in range(LEFT + 1):
        if step:
            # Induce: one byte earlier, stable in the order so far.
            key = group[order] * 256 + around[order, LEFT - step]
            by = np.argsort(key, kind="stable")
            key = key[by]
            same = np.flatnonzero(key[1:] == key[:-1])
            fresh = np.zeros(m, dtype=np.int64)
            fresh[same + 1] = np.minimum(1 + _least_between(common, by[same] + 1, by[same + 1]), LENGTH)
            order, common = order[by], fresh
        valid = (place[order] >= step) & (room[order] >= LENGTH - step)
        starts = np.flatnonzero(common < LENGTH)
        own = np.where(valid, doc[order], LAST)
        least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, m)))
        marks[order, step] = valid & (own > least)
    return marks


FOUND_RANGES = "doc long, text_key long, low int, high int, string binary"


def _intervals(doc: np.ndarray, key: np.ndarray, place: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
    """Marked strings of each tuple as byte ranges, neighbours joined."""
    edge = np.zeros((len(marks), 1), dtype=np.int8)
    change = np.diff(np.concatenate((edge, marks.astype(np.int8), edge), axis=1), axis=1)
    row, first = np.nonzero(change == 1)
    last = np.nonzero(change == -1)[1] - 1
    return _found(doc[row], key[row], place[row] - last, place[row] - first + LENGTH, None)


def _found(doc, key, low, high, strings: pa.Array | None) -> pa.RecordBatch:
    strings = pa.nulls(len(doc), pa.binary()) if strings is None else strings
    columns = [pa.array(doc), pa.array(key), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), strings]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "text_key", "low", "high", "string"])


def _one_by_one(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A part of the tuples of a name that very many documents have: what the part settles itself, and a row for each
    other string, which others may settle."""
    for first in range(0, rows.num_rows, SORTED_AT_ONCE // 2):
        part = rows.slice(first, SORTED_AT_ONCE // 2)
        name, doc, key, place, room = (part.column(n).to_numpy() for n in ("name", "doc", "text_key", "place", "room"))
        around = np.frombuffer(b"".join(part.column("around").to_pylist()), dtype=np.uint8).reshape(-1, SPAN)
        marks = induced_marks(name, doc, place, around, room)
        yield _intervals(doc, key, place.astype(np.int64), marks)
        for step in range(LEFT + 1):
            open_ = np.flatnonzero((place >= step) & (room >= LENGTH - step) & ~marks[:, step])
            data = np.ascontiguousarray(around[open_, LEFT - step : LEFT - step + LENGTH]).tobytes()
            strings = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(open_), [None, pa.py_buffer(data)]).cast(pa.binary())
            yield _found(doc[open_], key[open_], place[open_] - step, place[open_] - step + LENGTH, strings)


def _sorted_tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked ranges of all tuples, which come in order of name; of names with many members the strings themselves."""
    held: list[pa.RecordBatch] = []
    passing: int | None = None  # the name whose tuples go on one by one

    def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
        name, doc, key, place, room = (rows.column(n).to_numpy() for n in ("name", "doc", "text_key", "place", "room"))
        around = np.frombuffer(b"".join(rows.column("around").to_pylist()), dtype=np.uint8).reshape(-1, SPAN)
        return _intervals(doc, key, place.astype(np.int64), induced_marks(name, doc, place, around, room))

    for batch in batches:
        if passing is not None and batch.num_rows:
            same = int(np.searchsorted(batch.column("name").to_numpy(), passing, "right"))
            yield from _one_by_one(batch.slice(0, same))
            batch = batch.slice(same)
            passing = passing if not batch.num_rows else None
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= SORTED_AT_ONCE:
            rows = pa.concat_batches(held)
            names = rows.column("name").to_numpy()
            cut = int(np.searchsorted(names, names[-1]))
            if cut:
                yield settle(rows.slice(0, cut))
            held = [rows.slice(cut)]
            if held[0].num_rows > MANY:
                yield from _one_by_one(held[0])
                held, passing = [], int(names[-1])
    if held:
        yield settle(pa.concat_batches(held))


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, text, ranges in zip(batch.column(0).to_pylist(), text_bytes(batch.column(2)), batch.column(3).to_pylist()):
            kept, at, removed, spans = [], 0, 0, 0
            last = -1
            for low, high in sorted((r["low"], r["high"]) for r in ranges or ()):
                if low > last:
                    kept.append(text[at:low])
                    spans += 1
                    removed += high - low
                    at = last = high
                elif high > last:
                    removed += high - last
                    at = last = high
            rest = b"".join([*kept, text[at:]])
            out.append((doc, len(text), removed, spans, hashlib.sha256(rest).hexdigest(), *([rest] if whole else [])))
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * whole
        names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * whole
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * len(kinds), kinds)], names=names)


def _maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with a flag that is false only if ``keys`` doesn't have the row's (doc, text_key).

    The flag comes from a bitmap of fixed size, the only thing broadcast; so most texts needn't move to learn that
    they have no partner. A false hit costs the move of one text.
    """
    slot = F.pmod(F.xxhash64("doc", "text_key"), F.lit(FILTER_BITS))
    bitmaps = keys.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / PER_BITMAP).alias("map")).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(PER_BITMAP))).alias("bits"))
    bitmaps = F.broadcast(materialize(bitmaps, "text-bitmaps"))  # FILTER_BITS / PER_BITMAP rows of 4 KB at most
    marked = rows.withColumn("slot", slot).withColumn("map", F.floor(F.col("slot") / PER_BITMAP)).join(bitmaps, "map", "left")
    return marked.select(*rows.columns, F.coalesce(_bit(F.col("bits"), F.pmod("slot", F.lit(PER_BITMAP))), F.lit(False)).alias("maybe"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; with ``whole`` also the bytes kept.

    Every byte is removed that is covered by a LENGTH-byte string (UTF-8) which also starts in a row with a smaller id. Null counts
    as empty; texts shorter than LENGTH lose nothing; null ids come after all others. Rows with the same id never
    compete with each other, repeated rows get equal results. An empty table gives no row; other columns aren't read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    # Whole copies: the first document of equal texts stands for all; the others lose every byte.
    hashed = materialize(rows.select("doc", "text_key", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size")).where(F.col("size") >= LENGTH), "text-hashes")
    classes = hashed.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("final")).where("first < final").select("sha", "first")
    copies = hashed.join(classes, "sha").where("doc > first").select("doc", "text_key", F.lit(0).alias("low"), F.col("size").alias("high")).distinct()
    copies = materialize(copies, "whole-copies")
    # Only rows that a bitmap of the copies can't clear are compared with the copies themselves.
    marked = _maybe(rows, copies)
    firsts = marked.where("NOT maybe").drop("maybe").union(marked.where("maybe").drop("maybe").join(copies, ["doc", "text_key"], "left_anti"))

    # As many buckets as the bytes of text ask for: a task takes its buckets one after the other, in Spark's external order.
    tasks, size = int(spark.conf.get("spark.sql.shuffle.partitions")), hashed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(tasks, -(-size // BUCKET_BYTES))
    named = firsts.mapInArrow(_name_samples(buckets), FOUND).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    shared = named.mapInArrow(_shared_samples, "doc long, text_key long, places binary")
    shared = materialize(shared.groupBy("doc", "text_key").agg(F.collect_list("places").alias("places")), "shared-samples")  # bounded by a text's length

    having = _maybe(rows, shared).where("maybe").join(shared, ["doc", "text_key"])
    tuples = having.select("doc", "text_key", "text", "places").mapInArrow(_tuples, TUPLES)
    found = tuples.repartition("name").sortWithinPartitions("name").mapInArrow(_sorted_tuples, FOUND_RANGES)
    found = materialize(found, "ranges")
    single = found.where("string IS NOT NULL")
    least = single.groupBy("string").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("string", "least")
    single = single.join(least, "string").where("doc > least").select("doc", "text_key", "low", "high")
    ranges = found.where("string IS NULL").select("doc", "text_key", "low", "high").union(single).union(copies)
    ranges = materialize(ranges.groupBy("doc", "text_key").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "ranges-by-text")

    # Texts that surely lose nothing are cut where they are read.
    none = F.array().cast("array<struct<low:int,high:int>>").alias("ranges")
    marked = _maybe(rows, ranges)
    whole_ones = marked.where("NOT maybe").select("doc", "text_key", "text", none)
    others = marked.where("maybe").drop("maybe").join(ranges, ["doc", "text_key"], "left").select("doc", "text_key", "text", "ranges")
    result = whole_ones.union(others).mapInArrow(lambda batches: _cut(batches, whole), RESULT + ", kept binary" * whole)
    own = F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id")
    return result.select(own, *result.columns[1:])
