"""Best-fit packing of token sequences with dominance reduction.

Lengths are integers up to the capacity, so the whole corpus is described by one count per length. The
packing is decided on these counts: dominance rules first fix whole classes of sequences at once, best-fit
decreasing packs what is left. A decision is a run: "the items of length s with ranks a..b go, q to a
sequence, into sequences c.. at offset o". Every documented step uses up a length or a run of equal
sequences, and a sequence receives at most sqrt(2 * capacity) different lengths, so the number of runs depends
on the capacity alone, not on the corpus. Items find their run by their rank among items of equal length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provframe.llm.common import materialize, tidy

CAPACITY = 4096
END_ID = 1
#: Words kept with their ids in each Python worker, and the longest such word.
CACHED_WORDS, CACHED_CHARS = 400_000, 48
#: The vocabulary's pattern always parts a letter or digit from what is neither. Only letters whose small form is one letter.
CLOSING = re.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,;:!?*#$%&|<>])")
#: Items of one length are ranked in blocks of about so many rows, at least MIN_BLOCKS blocks.
BLOCK_ROWS, MIN_BLOCKS = 200_000, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_symbols() -> dict[int, str]:
    """The usual byte alphabet of such vocabularies: printable bytes stand for themselves, the rest follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Token ids of texts, as little-endian 32-bit integers.

    The vocabulary's splitting pattern never crosses white space and its normaliser treats white space as a
    separator, so a text's ids are those of its white-space words, one after the other; frequent words are kept.
    With ``added``, the vocabulary's added tokens stand for one id where a text spells them, as by default in the
    tokenizer; without, they are text like any other.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()] if added else []
        self._merges = self._tokenizer.model
        self._symbols = byte_symbols()
        self._known: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from one call that takes them as a sequence."""
        found = self._tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.asarray(found.ids, dtype="<u4")
        ends = 4 * np.searchsorted(np.asarray(found.word_ids, dtype=np.int64), np.arange(len(words) + 1))
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words: runs of small Latin letters go to the merges at once, all others through normaliser and pattern."""
        own, others = {}, []
        for word in words:
            if word.isalpha() and word == word.lower() and max(word) < "\u0100":
                symbols = word if word.isascii() else word.encode().decode("latin-1").translate(self._symbols)
                own[word] = np.array([x.id for x in self._merges.tokenize(symbols)], dtype="<u4").tobytes()
            else:
                others.append(word)
        if others:
            own.update(zip(others, self._encode(others)))
        return own

    @staticmethod
    def _split(text: str) -> list[str]:
        """White-space words, parted before closing punctuation; texts of Latin-1 alone in small letters, as the normaliser makes them."""
        if text.isascii() or max(text) < "\u0100":
            text = text.lower()
        return CLOSING.sub(" ", text).split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        # str.split() takes \x1c to \x1f as white space, the vocabulary doesn't; added tokens must not be parted.
        parted = ["\x1c", "\x1d", "\x1e", "\x1f", *self._added]
        odd = [any(c in text for c in parted) for text in texts]
        split = [[] if o else self._split(text) for o, text in zip(odd, texts)]
        known = self._known
        if len(known) > CACHED_WORDS:
            known.clear()
        new = set().union(*split).difference(known)
        known.update(self._learn(list(new)))
        found = [b"".join(map(known.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > CACHED_CHARS:
                del known[word]
        self._tokenizer.encode_special_tokens = not self._added
        for k, o in enumerate(odd):
            if o:
                found[k] = np.asarray(self._tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype="<u4").tobytes()
        self._tokenizer.encode_special_tokens = True
        return found


def portions(batch: pa.RecordBatch, chars: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    """The ids and texts of a batch, some million characters at a time."""
    ids, texts, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(doc)
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids plus the end id, cut at multiples of ``capacity``: one row per piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordIds(vocabulary, added=True), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for docs_, texts in portions(batch):
                for doc, found in zip(docs_, encode(texts)):
                    ids = memoryview(found + end)
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(cut), PIECES)


class Packing:
    """Runs of a packing: parallel lists of length, first rank, items in a sequence, sequences, first sequence, offset."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity:
                raise ValueError(f"length {length} is outside 1..{capacity}")
            self.left[length] += n
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _put(self, size: int, per: int, bins: int, sequence: int, offset: int) -> None:
        if per and bins:
            self.runs.append((size, int(self.used[size]), per, bins, sequence, offset))
            self.used[size] += per * bins
            self.left[size] -= per * bins

    def _fix(self, sizes: list[int], times: int) -> None:
        offset = 0
        for size in sizes:
            self._put(size, 1, times, self.sequences, offset)
            offset += size
        self.sequences += times

    def _reduce(self) -> None:
        """Fixes sets that dominate every other set that holds the same item (see the rules in ``_dominating``)."""
        for size in range(self.capacity, 0, -1):
            while self.left[size] and (found := self._dominating(size)):
                need = {s: found.count(s) for s in found}
                self._fix(found, min(int(self.left[s]) // n for s, n in need.items()))

    def _dominating(self, size: int) -> list[int]:
        """A set with ``size`` that dominates all feasible sets with it, or nothing if none is proved.

        A set dominates another if the other's items can be grouped so that each group fits in the place of one
        of the set's items. Rules, for the room that ``size`` leaves: nothing fits; one item fills the room; at
        most one item fits; at most two fit and none of these pairs exceeds the largest single item; at most two
        fit and the largest item with the largest beside it is at least as large in both places as any pair.
        """
        room = self.capacity - size
        self.left[size] -= 1
        try:
            others = np.flatnonzero(self.left[: room + 1])
            if not len(others):
                return [size]
            largest = int(others[-1])
            if largest == room:
                return [size, largest]
            low = np.repeat(others[:3], np.minimum(self.left[others[:3]], 3))[:3]
            if len(low) < 2 or low[:2].sum() > room:
                return [size, largest]
            if len(low) == 3 and low.sum() <= room:
                return []
            beside = others[np.maximum(np.searchsorted(others, room - others, "right") - 1, 0)]
            pairs = (others + beside)[others + beside <= room]
            if not len(pairs) or pairs.max() <= largest:
                return [size, largest]
            self.left[largest] -= 1
            second = np.flatnonzero(self.left[: room - largest + 1])
            self.left[largest] += 1
            half = others[: np.searchsorted(others, room // 2, "right")]
            if len(second) and (not len(half) or second[-1] >= half[-1]):
                return [size, largest, int(second[-1])]
            return []
        finally:
            self.left[size] += 1

    def _leave(self, room: int, sequence: int, bins: int) -> None:
        if room and bins:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((sequence, bins))

    def _best_fit(self) -> None:
        """Best-fit decreasing on what is left, a run of equal sequences at a time."""
        for size in range(self.capacity, 0, -1):
            while (n := int(self.left[size])) > 0:
                at = bisect_left(self.rooms, size)
                if at == len(self.rooms):
                    room, (sequence, bins) = self.capacity, (self.sequences, -(-n // (self.capacity // size)))
                    self.sequences += bins
                else:
                    room = self.rooms[at]
                    sequence, bins = self.open[room].pop()
                    if not self.open[room]:
                        del self.open[room], self.rooms[at]
                per = room // size
                full = min(bins, n // per)
                offset = self.capacity - room
                self._put(size, per, full, sequence, offset)
                self._leave(room - per * size, sequence, full)
                rest = min(n - full * per, per - 1) if full < bins else 0
                self._put(size, rest, 1, sequence + full, offset)
                if rest:
                    self._leave(room - rest * size, sequence + full, 1)
                    full += 1
                self._leave(room, sequence + full, bins - full)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to token pieces (columns of ``PIECES``). Reads ``pieces`` several times."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a length
    runs = np.array(sorted(Packing(counts, capacity).runs) or np.zeros((0, 6)), dtype=np.int64)
    blocks = max(MIN_BLOCKS, sum(counts.values()) // BLOCK_ROWS)
    ranked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = (
        ranked.groupBy("length", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "block", F.coalesce("before", F.lit(0)).alias("before"))
    )
    ranked = ranked.withColumn("within", F.row_number().over(within)).join(before, ["length", "block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))
    key = (runs[:, 0] << 44) | runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            run = runs[np.searchsorted(key, (length << 44) | rank, "right") - 1]
            k = rank - run[:, 1]
            sequence, offset = run[:, 4] + k // run[:, 2], run[:, 5] + k % run[:, 2] * length
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into as few sequences of at most ``capacity`` tokens as the rules above find.

    Only documents longer than the capacity are cut, at multiples of it. Null and empty texts are the end id
    alone; repeated rows and repeated ids are packed once for each row; ids may be null; an empty table gives no
    row. Other columns of ``docs`` are not read.
    """
    return pack(materialize(token_pieces(docs, vocabulary, capacity, id_col, text_col), "pieces"), capacity)
