"""SimHash near-duplicates with pivot distance tables.

Fingerprints within ``radius`` bits share whole blocks of bits: of ``blocks`` blocks at most ``radius`` differ, so the pairs
meet in a bucket for one choice of ``blocks - radius`` equal blocks. Distances of 64-bit fingerprints to a reference
spread by only four bits, so they can't deal out the work alone; inside a bucket they do the sifting: a
table holds every member's Hamming distance to many reference fingerprints, and as these differ by at most the
distance of the members themselves, a pair is discarded once one coordinate differs by more than ``radius``. Only
survivors are compared bit by bit. Buckets with many members are dealt out once more by their other bits.

A bucket gives links that connect what it connects, not all its pairs: a member that was reached from another is
compared only with members not reached yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provframe.llm.common import materialize, text_bytes, tidy
from provframe.llm.components import connected_components

BITS, SEED = 64, 42
SHINGLE, RADIUS = 4, 4
BLOCKS = 6
REFERENCES = 16
#: Buckets with more members are dealt out again by the bits that they need not share.
LARGE_BUCKET = 4096
#: Up to this size all pairs of a bucket are sifted at once.
SMALL_BUCKET = 48

LANES = np.uint64(0x0101010101010101)
PIVOTS = np.array([xxhash.xxh64_intdigest(b"reference %d" % k, SEED) for k in range(REFERENCES)], dtype=np.uint64)


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six white-space bytes
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes: a bit is set if it is in over half of the group."""
    result = np.zeros(len(sizes), dtype=np.uint64)
    if not len(hashes):
        return result
    full = np.flatnonzero(sizes)
    size = sizes[full]
    first = np.cumsum(size) - size
    # Counters of a byte each, eight to a word, can take 255 hashes.
    parts = -(-size // 255)
    owner_first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(owner_first, parts)
    starts = np.repeat(first, parts) + 255 * within
    counts = np.zeros((len(full), BITS), dtype=np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, starts)
        counts[:, bit::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), owner_first, axis=0)
    bits = np.packbits(2 * counts > size[:, None], axis=1, bitorder="little")
    result[full] = bits.view("<u8").ravel()
    return result


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) for every row: fp is the fingerprint as a signed 64-bit integer, zero for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, results = [], [], []

            def close() -> None:
                results.append(majorities(np.array(found, dtype=np.uint64), np.array(sizes, dtype=np.int64)))
                found.clear()
                sizes.clear()

            for text in text_bytes(batch.column(2)):
                hashes = shingle_hashes(text, shingle)
                found += hashes
                sizes.append(len(hashes))
                if len(found) > 500_000:
                    close()
            close()
            fp = np.concatenate(results).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "text_key", "fp"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text")).mapInArrow(
        tidy(run), "doc_id long, text_key long, fp long"
    )


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _masks(bits: list[int], blocks: int, shared: int) -> list[int]:
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(bits, blocks)]
    return [sum(chosen) for chosen in combinations(parts, shared)]


def _buckets(fps: DataFrame, radius: int, blocks: int, large: int) -> DataFrame:
    """(bucket, fp): each pair within the radius shares a bucket. Fingerprints of a large bucket move to finer ones."""
    masks = _masks(list(range(BITS)), blocks, blocks - radius)
    finer = [_masks([b for b in range(BITS) if not m >> b & 1], blocks, blocks - radius) for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "key"))
    full = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("choice", "key", F.lit(True).alias("large"))
    keyed = keyed.join(full, ["choice", "key"], "left")
    own = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in finer]), F.col("choice") + 1)
    parts = F.transform(own, lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(m).alias("part")))
    none = F.array(F.struct(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("part")))
    keyed = keyed.select("fp", "choice", "key", F.explode(F.when(F.col("large"), parts).otherwise(none)).alias("finer"))
    # Two buckets with the same hash would only be sifted together.
    return keyed.select(F.xxhash64("choice", "key", "finer.mask", "finer.part").alias("bucket"), "fp")


def distance_table(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def sift(fps: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are within the radius: discard by coordinates, a few at a time, verify what survives."""
    pairs = np.arange(len(left))
    for k in range(0, table.shape[1], 4):
        if not len(pairs):
            return pairs
        difference = np.abs(table[left[pairs], k : k + 4] - table[right[pairs], k : k + 4])
        pairs = pairs[difference.max(axis=1) <= radius]
    return pairs[np.bitwise_count(fps[left[pairs]] ^ fps[right[pairs]]) <= radius]


def spanning_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect a bucket's members exactly as all its pairs would; at most one fewer than members."""
    table = distance_table(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    rest, a, b = np.arange(len(fps)), [], []
    queue: list[int] = []
    while len(rest):
        if queue:
            at = queue.pop()
        else:
            at, rest = int(rest[0]), rest[1:]
        first = table[rest, 0]
        low, high = np.searchsorted(first, [table[at, 0] - radius, table[at, 0] + radius + 1])
        near = rest[low:high]
        hits = sift(fps, table, np.full(len(near), at), near, radius)
        if len(hits):
            reached = near[hits]
            a += [at] * len(reached)
            b += reached.tolist()
            queue += reached.tolist()
            rest = np.delete(rest, low + hits)
    return fps[np.array(a, dtype=np.int64)], fps[np.array(b, dtype=np.int64)]


def bucket_links(bucket: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of complete buckets, whose rows lie together."""
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(starts, len(bucket)))
    found = [spanning_links(fps[s : s + n], radius) for s, n in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET])]
    some = (sizes > 1) & (sizes <= SMALL_BUCKET)
    size = np.repeat(sizes[some], sizes[some])
    within = np.arange(len(size)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
    fps = fps[np.repeat(starts[some], sizes[some]) + within]
    table = distance_table(fps)
    for step in range(1, int(size.max(initial=1))):
        left = np.flatnonzero(within + step < size)
        hits = left[sift(fps, table, left, left + step, radius)]
        found.append((fps[hits], fps[hits + step]))
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)])


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, large: int = LARGE_BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of column ``fp`` that connect all that are within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bucket, open_fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def result(bucket: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
            a, b = bucket_links(bucket, members, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = np.concatenate((open_bucket, batch.column(0).to_numpy()))
            members = np.concatenate((open_fps, batch.column(1).to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(bucket, bucket[-1]))
            yield result(bucket[:cut], members[:cut])
            open_bucket, open_fps = bucket[cut:], members[cut:]
        if len(open_bucket):
            yield result(open_bucket, open_fps)

    rows = _buckets(fps, radius, blocks, large).repartition("bucket").sortWithinPartitions("bucket", "fp")
    return rows.mapInArrow(tidy(run), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id) for every row.

    component_id is the smallest id reachable over links of at most ``radius`` bits. Null and empty texts
    have fingerprint zero and link like any other; texts with fewer words than a shingle are one shingle. Repeated rows
    and copies share a fingerprint and are compared once. A null id is never the smallest unless a component has no
    other. An empty table gives no row. Other columns of ``docs`` are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(smallest, "root").select("fp", "component_id")
    component = F.coalesce("component_id", "first").alias("component_id")
    labels = distinct.join(linked, "fp", "left").select("fp", component)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(labels, "fp").select("doc_id", "text_key", digits, "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: the one with the smallest id, then the smallest text hash.

    Null and empty texts have fingerprint zero and are near each other. Of rows repeated in id and text one stays, the first by a
    hash of their other columns. Rows whose component has no id count as one group for each fingerprint. An empty table
    gives no row. Columns may have any name.
    """
    found = near_groups(docs, id_col, text_col, radius)
    last = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    # Rows without any id have component null and count as one component for each fingerprint.
    group = F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("unnamed")
    kept = found.groupBy("component_id", group).agg(F.min(last).alias("best")).select(F.col("best.doc_id").alias("keep_id"), F.col("best.text_key").alias("keep_key"))
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col(f"row.{id_col}").cast("long").alias("id"), F.xxhash64(text).alias("text_key"))
    one = Window.partitionBy("id", "text_key").orderBy(F.xxhash64(F.to_json("row")))
    rows = rows.withColumn("rank", F.row_number().over(one)).where("rank = 1")
    return rows.join(kept, rows["id"].eqNullSafe(kept["keep_id"]) & (rows["text_key"] == kept["keep_key"]), "left_semi").select("row.*")
