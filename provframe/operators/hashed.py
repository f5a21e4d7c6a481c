"""Checksums of a join's pairs where they meet: neither pairs nor their text are made as rows.

The checksum of a formula adds up a hash of each term's text, so every pair has to be hashed. Its text is that of one side's row and then that
of the other's. Rows of both sides, with their texts, are dealt to the cells of the join and handed to Python sorted by cell; there
pairs are numbers of two rows, told by comparing whole arrays, and hashed by :mod:`provframe.functions.digest`. What leaves a task is a
count and a sum for each tuple. Memory holds the rows of some cells, disk the dealt rows; only the work grows with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provframe.frame import KFrame, col_of
from provframe.functions import digest
from provframe.functions.witness import joined_names
from provframe.operators.intervals import Cells, tasks_of
from provframe.operators.pairs import _kept, _parted

TERMS, DIGEST = "__terms", "__digest"
#: Rows of whole cells that are worked on together, about, and bytes of their texts when all are as long as the longest.
ROWS_AT_ONCE, BYTES_AT_ONCE = 65536, 2**26
#: Pairs of a cell that are compared together, about.
COMPARED = 65536
#: Pairs of tuples whose sums have a place each; of more, only those met are kept. Pairs after which sums leave, so that they fit.
PLACED, SUMMED = 65536, 2**30
PLACE = [f"__place{k}" for k in range(5)]
SIDE, TEXT = "__side", "__text"
#: Attributes of these types can be told apart by their Arrow values.
TOLD = (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.BinaryType)


def sums(frame: KFrame) -> tuple[DataFrame, list[KFrame]] | None:
    """(attributes, number of terms, sum of their hashes) of a join's distinct pairs, more than once for a tuple; and the
    frames of the pairs of repeated rows, which have to be merged. None where the frame is more than a join, or its terms or conditions can't be told so."""
    if frame.pairs is None or frame.pairs.df is not frame.df or frame.has_names or frame.weighted or not frame._leaves_apart():
        return None
    pairs = frame.pairs
    sides = (pairs.left, pairs.right)
    if any(not side.leaves or side.weighted or any(x.optional for x in side.leaves) for side in sides):
        return None
    spaces = [sorted(f"{x.space}_".encode() for x in side.leaves) for side in sides]
    if spaces[0][-1] < spaces[1][0]:
        order = (0, 1)
    elif spaces[1][-1] < spaces[0][0]:
        order = (1, 0)
    else:
        return None
    kept = _kept(frame)
    if any(not isinstance(frame.df.schema[a].dataType, TOLD) for a in frame.attrs):
        return None
    (lone_left, many_left), (lone_right, many_right) = (_parted(side, names) for side, names in zip(sides, kept))
    texts = _texts(frame, sides, order, spaces)
    meetings = pairs.cells(*(side.df.withColumn(TEXT, text) for side, text in zip((lone_left, lone_right), texts)))
    found = None
    for cells in meetings:
        part = _summed(cells, frame, kept, order)
        if part is None:
            return None
        found = part if found is None else found.unionByName(part)
    rest = [replace(pairs.join(one, two).project(*frame.attrs), pairs=None) for one, two in ((many_left, pairs.right), (lone_left, many_right)) if one is not None and two is not None]
    return found, rest


def _texts(frame: KFrame, sides: tuple[KFrame, KFrame], order: tuple[int, int], spaces: list[list[bytes]]) -> list[Column]:
    """What a row of either side adds to a term's text: the first all up to where the second's rows begin to differ."""
    opened, glue, closed = ("", "·", "") if frame.semiring.keeps_exponents else ("(", " ∧ ", ")")
    first, second = order
    common = spaces[second][0].decode()  # a variable's name begins with its space
    texts: list[Column] = [F.lit("")] * 2
    texts[first] = F.concat(F.lit(opened), joined_names(sides[first].leaves, glue, ""), F.lit(glue + common))
    own = joined_names(sides[second].leaves, glue, "")
    texts[second] = F.concat(F.substr(own, F.lit(len(common) + 1)), F.lit(closed))
    return texts


def _number_type(a: T.DataType, b: T.DataType) -> str | None:
    """As what two values are compared: as SQL would, or None."""
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return "bigint"
    return "double" if a == b and isinstance(a, (T.DoubleType, T.FloatType)) else None


def _summed(cells: Cells, frame: KFrame, kept: tuple[list[str], list[str]], order: tuple[int, int]) -> DataFrame | None:
    sides = (cells.left, cells.right)
    values = [[], []]
    strict, kinds = [], []
    for k, (smaller, greater, left_smaller, unequal) in enumerate(cells.comparisons):
        own = (smaller, greater) if left_smaller else (greater, smaller)
        kind = _number_type(*(rows.select(x).schema[0].dataType for rows, x in zip(sides, own)))
        if kind is None:
            return None
        for side in (0, 1):
            values[side].append(own[side].cast(kind).alias(f"__x{k}"))
        kinds.append(kind)
        # Whether the side that comes first in a text has the smaller value.
        strict.append((left_smaller == (order[0] == 0), unequal))
    dealt = []
    for side, rows in enumerate(sides):
        place = [F.col(c).cast("bigint").alias(p) for c, p in zip(Cells.PLACES[side], PLACE)]
        attrs = [col_of(a).alias(f"__a{k}") if a in kept[side] else F.lit(None).cast(frame.df.schema[a].dataType).alias(f"__a{k}") for k, a in enumerate(frame.attrs)]
        dealt.append(rows.select(*place, F.lit(order.index(side)).cast("tinyint").alias(SIDE), F.col(TEXT), *values[side], *attrs))
    known = " AND ".join(f"__x{k} IS NOT NULL" for k in range(len(kinds)))
    place = PLACE[: len(Cells.PLACES[0])]
    rows = dealt[0].unionByName(dealt[1]).where(known)
    # More tasks than cores, as cells differ in their pairs.
    rows = rows.repartition(4 * tasks_of(rows), *place).sortWithinPartitions(*place, SIDE, TEXT)
    own = [[k for k, a in enumerate(frame.attrs) if a in kept[side]] for side in order]
    result = T.StructType([T.StructField(f"__a{k}", frame.df.schema[a].dataType) for k, a in enumerate(frame.attrs)])
    result = result.add(TERMS, T.LongType()).add(DIGEST, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches, place):
            yield from _sums_of(table, place, strict, own)

    found = rows.mapInArrow(run, result)
    return found.select(*[F.col(f"__a{k}").alias(a) for k, a in enumerate(frame.attrs)], TERMS, DIGEST)


def _starts(table: pa.Table, place: list[str]) -> np.ndarray:
    """For each row, whether a cell begins there."""
    new = np.zeros(len(table), dtype=bool)
    new[:1] = True
    for name in place:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def _whole_cells(batches: Iterator[pa.RecordBatch], place: list[str]) -> Iterator[pa.Table]:
    """The rows in tables that end where a cell ends."""
    waiting, count, longest = [], 0, 0
    for batch in batches:
        if not len(batch):
            continue
        waiting.append(batch)
        count += len(batch)
        longest = max(longest, int(np.diff(_text_of(batch.column(TEXT))[0]).max()))
        if count >= ROWS_AT_ONCE or count * longest >= BYTES_AT_ONCE:
            table = pa.Table.from_batches(waiting)
            last = int(np.flatnonzero(_starts(table, place))[-1])
            if last:
                yield table.slice(0, last)
                rest = table.slice(last).combine_chunks()
                waiting, count, longest = rest.to_batches(), len(rest), 0
            # A cell that goes on is looked at again when as many rows more are there.
            count = 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where texts begin and end, and their bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _ordered(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers in the order of the values: NaN is equal to itself and above all others, zeros are equal."""
    values = column.to_numpy()
    if values.dtype != np.float64:
        return values
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _codes(table: pa.Table, columns: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's attributes, and a row for each number."""
    codes, first = np.zeros(len(table), np.int64), np.zeros(min(1, len(table)), np.int64)
    for k in columns:
        own = table.column(f"__a{k}").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        _, first, codes = np.unique(codes * (int(own.max(initial=0)) + 1) + own, return_index=True, return_inverse=True)
    return codes, first


def _sums_of(table: pa.Table, place: list[str], strict: list[tuple[bool, bool]], own: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """Counts and sums by tuple of the pairs in the cells of a table. ``strict`` says of each comparison whether the first side's value is
    the smaller one, and whether it must differ."""
    cell = np.cumsum(_starts(table, place)) - 1
    side = table.column(SIDE).to_numpy()
    rows = [np.flatnonzero(side == s) for s in (0, 1)]
    if not all(len(r) for r in rows):
        return
    first, second = (table.take(r).combine_chunks() for r in rows)
    # Rows of the second side that a row of the first side meets.
    begins, ends = (np.searchsorted(cell[rows[1]], cell[rows[0]], how) for how in ("left", "right"))
    values = [[_ordered(t.column(f"__x{k}")) for k in range(len(strict))] for t in (first, second)]
    groups = [_codes(t, columns) for t, columns in zip((first, second), own)]
    wide = len(groups[1][1])
    found = _Sums(len(groups[0][1]) * wide)

    def batch() -> pa.RecordBatch:
        numbers, terms, total = found.taken()
        columns = {f"__a{k}": t.column(f"__a{k}").combine_chunks().take(pa.array(at[n])) for t, columns, (_, at), n in zip((first, second), own, groups, (numbers // wide, numbers % wide)) for k in columns}
        names = [f"__a{k}" for k in range(len(columns))]
        return pa.RecordBatch.from_arrays([*(columns[n] for n in names), pa.array(terms), pa.array(total)], names=[*names, TERMS, DIGEST])

    heads, lengths = digest.padded(*_text_of(first.column(TEXT)))
    tails, tail_lengths = digest.padded(*_text_of(second.column(TEXT)))
    for length in np.unique(lengths):
        alike = np.flatnonzero((lengths == length) & (ends > begins))
        if not len(alike):
            continue
        prepared = digest.Heads(heads[alike, :length])
        blocks = digest.blocks_of(prepared, tail_lengths)
        for count in np.unique(blocks):
            those = np.flatnonzero(blocks == count)
            # Of the rows of these lengths, those of the cell, as stretches of ``those``.
            low, high = np.searchsorted(those, begins[alike]), np.searchsorted(those, ends[alike])
            made = digest.Tails(prepared, tails[those], tail_lengths[those], int(count))
            first_group, second_group = groups[0][0][alike] * wide, groups[1][0][those]
            compared = [(values[0][k][alike], values[1][k][those], *strict[k]) for k in range(len(strict))]
            for i, j in digest.in_lanes(_pairs(low, high, compared)):
                found.add(first_group.take(i) + second_group.take(j), digest.digests(prepared, made, i, j))
                if found.full:
                    yield batch()
    if found.count:
        yield batch()


def _pairs(low: np.ndarray, high: np.ndarray, compared: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row and one of its stretch of the others that pass all comparisons."""
    counts = high - low
    before = np.concatenate(([0], np.cumsum(counts)))
    at = 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(before, before[at] + COMPARED, "right")) - 1)
        some = counts[at:end]
        j = np.arange(before[end] - before[at])
        j += np.repeat(low[at:end] - (before[at:end] - before[at]), some)
        keep = None
        for mine, others, smaller, unequal in compared:
            x, y = np.repeat(mine[at:end], some), others.take(j)
            passed = (x < y if unequal else x <= y) if smaller else (y < x if unequal else y <= x)
            keep = passed if keep is None else np.logical_and(keep, passed, out=keep)
        if len(j):
            kept = np.flatnonzero(keep)
            yield np.repeat(np.arange(at, end), some).take(kept), j.take(kept)
        at = end


class _Sums:
    """Number of terms and sum of their hashes by pair of tuples."""

    def __init__(self, places: int):
        self.places = places if places <= PLACED else None
        self._clear()

    def _clear(self) -> None:
        self.count = 0
        self._met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if self.places is not None:
            self._terms, self._total = np.zeros(self.places, np.int64), np.zeros(self.places, np.int64)

    @property
    def full(self) -> bool:
        return self.count >= SUMMED or sum(len(n) for n, _, _ in self._met) >= 2**20

    def add(self, numbers: np.ndarray, hashes: np.ndarray) -> None:
        self.count += len(numbers)
        if self.places is None:
            at, numbers = np.unique(numbers, return_inverse=True)
            self._met.append((at, np.bincount(numbers), np.bincount(numbers, weights=hashes).astype(np.int64)))
        else:  # sums of few 32-bit numbers are exact as doubles
            self._terms += np.bincount(numbers, minlength=self.places)
            self._total += np.bincount(numbers, weights=hashes, minlength=self.places).astype(np.int64)

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What has been added up, which is then forgotten."""
        if self.places is None:
            at, terms, total = (np.concatenate(x) for x in zip(*self._met))
        else:
            at = np.flatnonzero(self._terms)
            terms, total = self._terms[at], self._total[at]
        self._clear()
        return at, terms.astype(np.int64), total
