"""Hard negatives by a vertical scan with branch-and-bound on dimensions (BOND).

Vectors are stored by column: a block of rows holds, for each dimension, the components of all its rows, with their least
and greatest value. An anchor reads the dimensions in descending order of its own magnitudes, half of the remaining ones
at a time. After each step a row's score lies between its partial score plus the least and plus the greatest that the unread
dimensions can contribute, and the candidate bitmap loses the rows that cannot belong to the result any more. What is left when all
dimensions are read has exact scores.

Two scans: the first finds every anchor's positives, the second, with the score windows that these give, its negatives.
Both meet anchors and blocks in cells of bounded size, a group of anchors against a deal of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provframe.llm.common import materialize

POSITIVES, NEGATIVES = 5, 10
#: Negatives score from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 30, 90
SCALE = 256
#: Rows of a block; rows of a cell, more where there are fewer cells than LEAST_CELLS; anchors of a cell. They shape tasks, not results.
BLOCK_ROWS, CELL_ROWS, LEAST_CELL_ROWS, LEAST_CELLS, CELL_ANCHORS = 8192, 131_072, 4096, 16, 4096
#: The last dimensions are read together.
LAST_DIMENSIONS = 4

VERTICAL = "block string, dims int, n int, ids binary, labels binary, kind string, components binary"


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vector (whole numbers as doubles) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    vec_id, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    rows = vectors.select(vec_id.alias("vec_id"), label.alias("given"), F.col(vector_col).cast("array<double>").alias("given_vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("given").isNotNull() & F.col("given_vector").isNotNull() & F.forall("given_vector", finite))
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("given") + 1) % 10).otherwise(F.col("given"))
    return rows.select("vec_id", relabelled.alias("label"), F.col("given_vector").alias("vector"))


def _scaled(column: pa.Array, dims: int) -> np.ndarray:
    """Rows × dimensions of equally long vectors, each component floored after scaling."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    found = np.floor(SCALE * flat.flatten().to_numpy(zero_copy_only=False)).reshape(len(flat), dims)
    if not np.isfinite(found).all():
        raise OverflowError("a component is too large to be scaled")
    return found


def _vertical(rows: DataFrame) -> DataFrame:
    """Rows in blocks by column, equally long vectors together, ordered by label and id within a block."""

    def block(dims: int, ids: list[np.ndarray], labels: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        own_ids, own_labels, matrix = np.concatenate(ids), np.concatenate(labels), np.concatenate(vectors)
        order = np.lexsort((own_ids, own_labels))
        small = not matrix.size or np.abs(matrix).max() < 2**15
        kind = "<i2" if small else "<f8"
        value = {
            "block": uuid.uuid4().hex, "dims": dims, "n": len(order), "ids": own_ids[order].astype("<i8").tobytes(),
            "labels": own_labels[order].astype("<i8").tobytes(), "kind": kind, "components": np.ascontiguousarray(matrix[order].T).astype(kind).tobytes(),
        }
        return pa.RecordBatch.from_pylist([value], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == dims))
                for low in range(0, own.num_rows, BLOCK_ROWS):
                    some = own.slice(low, BLOCK_ROWS)
                    parts = held.setdefault(dims, ([], [], []))
                    parts[0].append(some.column("vec_id").to_numpy(zero_copy_only=False))
                    parts[1].append(some.column("label").to_numpy(zero_copy_only=False))
                    parts[2].append(_scaled(some.column("vector"), dims))
                    if sum(map(len, parts[0])) >= BLOCK_ROWS:
                        yield block(dims, *held.pop(dims))
        for dims, parts in held.items():
            yield block(dims, *parts)

    schema = pa.schema([("block", pa.string()), ("dims", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("components", pa.binary())])
    return rows.mapInArrow(run, VERTICAL)


class Block:
    """Columns of a block as floats that hold every score exactly, or as Python integers where no float does."""

    def __init__(self, row: dict, anchors: np.ndarray):
        dims, n = row["dims"], row["n"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        columns = np.frombuffer(row["components"], row["kind"]).reshape(dims, n)
        self.low, self.high = (columns.min(axis=1).astype(float), columns.max(axis=1).astype(float)) if n else (np.zeros(dims), np.zeros(dims))
        largest = np.abs(anchors).max(axis=0, initial=0) @ np.maximum(np.abs(self.low), np.abs(self.high)) if dims else 0
        self.kind = np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else object
        if self.kind is object:
            columns, self.low, self.high = (np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape) for x in (columns, self.low, self.high))
        self.columns = columns.astype(self.kind)

    def range_of(self, label: int) -> tuple[int, int]:
        low, high = np.searchsorted(self.labels, [label, label + 1])
        return int(low), int(high)

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, verdict: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Rows that survive every verdict(least, greatest possible scores), with their exact scores."""
        vector = np.array([int(v) for v in anchor], dtype=object) if self.kind is object else anchor.astype(self.kind)
        order = np.argsort(-np.abs(anchor), kind="stable")
        first, second = vector * self.low.astype(self.kind), vector * self.high.astype(self.kind)
        least = np.concatenate((np.cumsum(np.minimum(first, second)[order][::-1])[::-1], [0]))
        greatest = np.concatenate((np.cumsum(np.maximum(first, second)[order][::-1])[::-1], [0]))
        scores, read, dims = np.zeros(len(candidates), dtype=self.kind), 0, len(order)
        whole = len(candidates) == len(self.ids)
        while len(candidates) and read < dims:
            step = dims - read if dims - read <= LAST_DIMENSIONS else (dims - read) // 2
            now = order[read : read + step]
            part = self.columns[now] if whole else self.columns[np.ix_(now, candidates)]
            scores = scores + vector[now] @ part
            read += step
            alive = verdict(scores + least[read], scores + greatest[read], candidates)
            if not alive.all():
                candidates, scores, whole = candidates[alive], scores[alive], False
        return candidates, scores


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` by descending score, then ascending id."""
    if len(rows) > count:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
    else:
        kept = np.arange(len(rows))
    return kept[np.lexsort((ids[rows[kept]], -scores[kept]))][:count]


def _cells(run: Callable[[dict, np.ndarray, Block], Iterator[tuple]], names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a cell's blocks and anchors that runs every anchor on every block."""

    def cell(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if blocks.num_rows and anchors.num_rows:
            dims = blocks["dims"][0].as_py()
            matrix = _scaled(anchors["vector"], dims)
            others = anchors.drop_columns(["vector"]).to_pylist()
            for row in blocks.to_pylist():
                block = Block(row, matrix)
                for anchor, vector in zip(others, matrix):
                    out.extend(run(anchor, vector, block))
        columns = list(zip(*out)) or [()] * len(names)
        return pa.table([pa.array([None if v is None else int(v) for v in c], pa.int64()) for c in columns], names=names)

    return cell


def _nearest(anchor: dict, vector: np.ndarray, block: Block) -> Iterator[tuple]:
    """The block's rows that may be among the anchor's positives or be the anchor itself."""
    count = POSITIVES + 1

    def verdict(least: np.ndarray, greatest: np.ndarray, _) -> np.ndarray:
        if len(least) <= count:
            return np.ones(len(least), dtype=bool)
        return greatest >= np.partition(least, len(least) - count)[len(least) - count]

    rows, scores = block.scan(vector, np.arange(*block.range_of(anchor["label"])), verdict)
    for k in _best(rows, scores, block.ids, count):
        row = rows[k]
        itself = block.ids[row] == anchor["vec_id"] and bool((block.columns[:, row] == vector.astype(block.kind)).all())
        yield anchor["anchor"], scores[k], block.ids[row], itself


def _in_windows(anchor: dict, vector: np.ndarray, block: Block) -> Iterator[tuple]:
    """The block's rows that may be among the anchor's negatives for one of its positives."""
    windows = {p["score"]: (-(-LOW * p["score"] // 100), HIGH * p["score"] // 100) for p in anchor["positives"]}
    windows = {score: (low, high) for score, (low, high) in windows.items() if low <= high}
    if not windows:
        return
    same = block.range_of(anchor["label"])

    def verdict(least: np.ndarray, greatest: np.ndarray, rows: np.ndarray) -> np.ndarray:
        alive = np.zeros(len(rows), dtype=bool)
        for low, high in windows.values():
            possible = (greatest >= low) & (least <= high)
            sure = least[possible & (least >= low) & (greatest <= high)]
            if len(sure) > NEGATIVES:
                possible &= greatest >= np.partition(sure, len(sure) - NEGATIVES)[len(sure) - NEGATIVES]
            alive |= possible
        return alive

    candidates = np.concatenate((np.arange(same[0]), np.arange(same[1], len(block.ids))))
    rows, scores = block.scan(vector, candidates, verdict)
    found = {}
    for score, (low, high) in windows.items():
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        best = inside[_best(rows[inside], scores[inside], block.ids, NEGATIVES)]
        found[score] = [(block.ids[rows[k]], scores[k]) for k in best]
    for p in anchor["positives"]:
        for negative_id, negative_score in found.get(p["score"], ()):
            yield anchor["anchor"], anchor["vec_id"], p["place"], p["id"], p["score"], negative_id, negative_score


def _meet(blocks: DataFrame, anchors: DataFrame, deals: int, groups: int, run: Callable, names: list[str]) -> DataFrame:
    """Every anchor against every block of its vector length, in cells."""
    deal = F.pmod(F.xxhash64("block"), F.lit(deals)).cast("int")
    left = blocks.withColumn("deal", deal).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    group = F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")
    right = anchors.withColumn("dims", F.size("vector")).withColumn("group", group).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    cell = ["dims", "deal", "group"]
    schema = ", ".join(f"{n} long" for n in names)
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cells(run, names), schema)


def _first(df: DataFrame, by: list[str], order: list[Column], count: int, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")).where(F.col(name) <= count)


def mined(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor, a row whose id is divisible by 100.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths have no
    score with each other; empty vectors score 0 with each other. Every row counts for itself: a repeated anchor is an anchor as
    often and a positive of the others, repeated negatives are returned each. Ties go by smaller id. An empty table, or
    one without anchors, gives no row; other columns are not read. Scores beyond 64 bits raise.
    """
    rows = _usable(vectors, id_col, vector_col, label_col)
    blocks = materialize(_vertical(rows), "vertical-blocks")
    anchors = materialize(rows.where(F.col("vec_id") % 100 == 0).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    total, asked = blocks.agg(F.sum("n")).head()[0] or 0, anchors.count()
    deals = max(total // CELL_ROWS, min(LEAST_CELLS, total // LEAST_CELL_ROWS)) + 1
    groups = asked // CELL_ANCHORS + 1
    near = _meet(blocks, anchors, deals, groups, _nearest, ["anchor", "score", "id", "itself"])
    near = _first(near, ["anchor"], [F.col("score").desc(), F.col("id"), F.col("itself").desc()], POSITIVES + 1, "place")
    # The anchor's own row goes, once: of the first rows like it the first, or none where it is not among them.
    own = F.min(F.when(F.col("itself") == 1, F.col("place"))).over(Window.partitionBy("anchor"))
    others = near.withColumn("own", own).where(F.col("own").isNull() | (F.col("place") != F.col("own")))
    others = others.withColumn("place", F.when(F.col("place") > F.col("own"), F.col("place") - 1).otherwise(F.col("place"))).where(F.col("place") <= POSITIVES)
    positives = others.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))  # POSITIVES at most
    asking = materialize(anchors.join(positives, "anchor"), "anchors-positives")
    names = ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = _meet(blocks, asking, deals, groups, _in_windows, names)
    ranked = _first(found, ["anchor", "place"], [F.col("negative_score").desc(), F.col("negative_id")], NEGATIVES, "rank")
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
