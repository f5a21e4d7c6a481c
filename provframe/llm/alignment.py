"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both token sequences of a text cover the same bytes, so each is an ascending array of end offsets. Where both have
the same end, the text is cut into groups. The arrays are walked together at an index shift: from a common end on, stretches
where tokens correspond one to one are found by comparing array slices of doubling length at the current shift and
halving back to the first difference. What begins there is an irregular group: it is resolved token by token up to the next common
end, which gives the shift for the next stretch.

How often a pair of ids is linked is a statistic of the whole corpus. Documents are coded once, in blocks of bounded size
that keep a dictionary of their pairs; the dictionaries are added up by pair, and each block gets back the
totals of its own entries. So neither pairs per document nor totals of the whole corpus are ever held in one place.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provframe.llm.common import Recent, materialize
from provframe.llm.packing import byte_symbols
from provframe.llm.piece_bpe import PieceCoder

#: A block of documents ends with the one that brings it to so many links.
BLOCK_LINKS = 2_000_000
#: Parts met recently that each Python worker keeps with their ids (twice as many at most), and the longest such part.
CACHED, CACHED_CHARS = 350_000, 40
#: Characters of the texts whose unknown parts are encoded in one call.
CHUNK_CHARS = 300_000
#: Ends compared one by one before a run is probed in steps of doubling length.
SHORT_RUN = 4
#: Both vocabularies part words before a single space or line end between two such characters.
SEAM = re.compile(r"(?<=[!-~À-ɏ])(?=[ \n][!-~À-ɏ])")
#: Characters on whose classes all versions of the splitting pattern agree.
PLAIN = re.compile(r"[ \n!-~À-ÖØ-öø-ɏ]+").fullmatch
#: Parts of such characters with a seam on both sides, wherever another such part stands beside them.
SEAMED = re.compile(r"[ \n](?=[!-~À-ÖØ-öø-ɏ])[ \n!-~À-ÖØ-öø-ɏ]*(?<=[!-~À-ÖØ-öø-ɏ])").fullmatch
#: Such parts that are encoded as one text.
ROW = 512
#: A pair of ids as one number.
PAIR = 1 << 32

DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
BLOCK = f"block string, pairs array<long>, counts array<long>, docs array<struct<{DOCUMENT.replace(' ', ':').replace(',:', ',')},slots:binary,times:binary>>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[int, int, int, int, bool]]:
    """Stretches (a, b, n_a, n_b, single) of two end arrays with the same last end, in order: ``single`` stands for n_a == n_b groups
    of one token each; otherwise the tokens form one group, of which at least one side has several.
    """
    a, b = ends_a.astype("<i8"), ends_b.astype("<i8")
    raw_a, raw_b, list_a, list_b = a.tobytes(), b.tobytes(), a.tolist(), b.tolist()
    i, j, n_a = 0, 0, len(list_a)
    # Beyond the last ends, which are equal, nothing is.
    list_a.append(-1)
    list_b.append(-2)
    while i < n_a:
        # At this shift j - i, how far do the ends agree?
        run = 0
        while run < SHORT_RUN and list_a[i + run] == list_b[j + run]:
            run += 1
        if run == SHORT_RUN:
            most, step = min(n_a - i, len(list_b) - 1 - j), SHORT_RUN
            while run < most:
                if step > most - run:
                    step = most - run
                low_a, low_b = 8 * (i + run), 8 * (j + run)
                if raw_a[low_a : low_a + 8 * step] == raw_b[low_b : low_b + 8 * step]:
                    run += step
                    step *= 2
                elif step == 1:
                    break
                else:
                    if run + step < most:
                        most = run + step
                    step //= 2
        if run:
            yield i, j, run, run, True
            i, j = i + run, j + run
            if i == n_a:
                return
        # An irregular group, up to the next common end.
        p, q = i, j
        x, y = list_a[p], list_b[q]
        while x != y:
            if x < y:
                p += 1
                x = list_a[p]
            else:
                q += 1
                y = list_b[q]
        yield i, j, p + 1 - i, q + 1 - j, False
        i, j = p + 1, q + 1


class Vocabularies:
    """Both tokenizers, and the bytes, lengths and written ids of their tokens."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.bytes = Tokenizer.from_file(bytes_path)
        self.bytes.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        codes = {symbol: b for b, symbol in byte_symbols().items()}
        special = set(self.bytes.get_added_tokens_decoder())
        size = max(self.bytes.get_vocab().values()) + 1
        vocabulary = [self.bytes.id_to_token(k) for k in range(size)]
        self.tokens_a = [b"" if k in special or t is None else bytes(codes[c] for c in t) for k, t in enumerate(vocabulary)]
        ranks = {t: k for k, t in enumerate(self.tokens_a) if t}
        #: The same merges without the cost of a full encoding, for parts of plain characters.
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tokens_b = [s or b"" for s in PieceCoder(pieces_path).surfaces]
        self.length_a = np.array([len(t) for t in self.tokens_a], dtype=np.int64)
        self.length_b = np.array([len(t) for t in self.tokens_b], dtype=np.int64)
        #: Written ids inside groups, from ``last_a`` on those at the end of a group's A side, from ``last_b`` on at the end of a group.
        self.last_a = max(size, len(self.tokens_b))
        self.last_b = 2 * self.last_a
        self.written = np.array([f"{k}{mark}" for mark in ",|;" for k in range(self.last_a)], dtype=object)


class Aligner:
    """Tokens of both vocabularies for a text, their groups and links."""

    def __init__(self, bytes_path: str, pieces_path: str):
        own = vocabularies(bytes_path, pieces_path)
        self._bytes, self._pieces, self._plain = own.bytes, own.pieces, own.plain
        self.tokens_a, self.tokens_b = own.tokens_a, own.tokens_b
        self._length_a, self._length_b = own.length_a, own.length_b
        self._last_a, self._last_b, self._words = own.last_a, own.last_b, own.written
        self._known = Recent(CACHED)

    def _encode(self, parts: list[str]) -> list[tuple[bytes, bytes] | tuple[()]]:
        """Ids of each part in both vocabularies; nothing if their bytes are not those of the part."""
        seamed = [p for p in parts if SEAMED(p)]
        found: dict[str, tuple[bytes, bytes] | tuple[()]] = {}
        for k in range(0, len(seamed), ROW):
            own = seamed[k : k + ROW]
            found.update(zip(own, self._encode_row(own)))
        others = [p for p in parts if p not in found]
        found.update(zip(others, self._encode_each(others)))
        return [found[p] for p in parts]

    def _encode_row(self, parts: list[str]) -> list[tuple[bytes, bytes] | tuple[()]]:
        """``_encode`` of parts with seams: encoded as one text, which is cut where they end. If its bytes differ, each half is tried."""
        row = "".join(parts)
        data = row.encode()
        a, b = self._plain(row), self._pieces.encode(row[1:] if row[0] == " " else row, num_threads=1)
        if row[0] != " ":
            b = b[1:]
        if b"".join(map(self.tokens_a.__getitem__, a)) == data and b"".join(map(self.tokens_b.__getitem__, b)) == data:
            ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in parts])
            ids, cuts = [], []
            for own, lengths in ((a, self._length_a), (b, self._length_b)):
                tokens = np.array(own, dtype="i4")
                own_ends = np.cumsum(lengths[tokens])
                at = np.searchsorted(own_ends, ends)
                if (own_ends[at] != ends).any():
                    break
                ids.append(tokens.tobytes())
                cuts.append([0, *(4 * (at + 1)).tolist()])
            else:
                (a, b), (cut_a, cut_b) = ids, cuts
                return [(a[i:j], b[m:n]) for i, j, m, n in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        if len(parts) == 1:
            return self._encode_each(parts)
        half = len(parts) // 2
        return self._encode_row(parts[:half]) + self._encode_row(parts[half:])

    def _encode_each(self, parts: list[str]) -> list[tuple[bytes, bytes] | tuple[()]]:
        """``_encode`` of any parts, one by one.

        The pieces put a space in front: the one that the part has, or one that stands alone before a line end.
        """
        result, tokens_a, tokens_b = [], self.tokens_a.__getitem__, self.tokens_b.__getitem__
        for part, b in zip(parts, self._pieces.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)):
            if part[0] != " ":
                b = b[1:]
            a = self._plain(part) if PLAIN(part) else self._bytes.encode(part, add_special_tokens=False).ids
            data = part.encode()
            same = b"".join(map(tokens_a, a)) == data and b"".join(map(tokens_b, b)) == data
            result.append((array("i", a).tobytes(), array("i", b).tobytes()) if same else ())
        return result

    def ids(self, texts: list[str | None]) -> list[list[tuple[bytes, bytes] | tuple[()]]]:
        """Ids of the parts of space + text, for each text: in both vocabularies, nothing if their bytes are not those of the part.

        Parts between seams don't touch in either vocabulary, so recent ones are kept; those not known yet are encoded together.
        """
        parts, known = [SEAM.split(" " + text) if text else [] for text in texts], self._known
        found = [[known[p] for p in own] for own in parts]
        missing = list({p for own, ids in zip(parts, found) if None in ids for p, x in zip(own, ids) if x is None})
        fresh = dict(zip(missing, self._encode(missing)))
        for part, ids in fresh.items():
            if len(part) <= CACHED_CHARS:
                known.keep(part, ids)
        return [[fresh[p] if x is None else x for p, x in zip(own, ids)] if None in ids else ids for own, ids in zip(parts, found)]

    def aligned_texts(self, texts: Iterator[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """``align`` of many texts, in order."""
        held: list[str | None] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size > CHUNK_CHARS:
                yield from map(self._align, self.ids(held))
                held, size = [], 0
        yield from map(self._align, self.ids(held))

    def align(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """(tokens A, tokens B, groups, groups as text, linked id pairs); nothing where the vocabularies' bytes differ from the text's."""
        return self._align(self.ids([text])[0])

    def _align(self, found: list[tuple[bytes, bytes] | tuple[()]]) -> tuple[int, int, int, str, np.ndarray]:
        if not found or () in found:
            return 0, 0, 0, "", np.zeros(0, dtype=np.int64)
        a, b = (np.frombuffer(b"".join(own), dtype="i4") for own in zip(*found))
        ends_a, ends_b = np.cumsum(self._length_a[a]), np.cumsum(self._length_b[b])
        stretches = np.fromiter(chain.from_iterable(aligned(ends_a, ends_b)), dtype=np.int64).reshape(-1, 5)
        single = stretches[:, 4] > 0
        runs, groups = stretches[single, :3], stretches[~single, :4]
        straight_a, straight_b = _places(runs)
        links_a, links_b = _links(ends_a, ends_b, straight_a, straight_b)
        from_a, from_b = np.concatenate((straight_a, links_a)), np.concatenate((straight_b, links_b))
        pairs = a[from_a].astype(np.int64) * PAIR + b[from_b]
        return len(a), len(b), len(straight_a) + len(groups), self._written(a, b, straight_a, straight_b, groups), pairs

    def _written(self, a: np.ndarray, b: np.ndarray, straight_a: np.ndarray, straight_b: np.ndarray, groups: np.ndarray) -> str:
        """The groups in order: a token comes after the tokens of its side, and after those of the other side in earlier groups (its own, too, for B)."""
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[straight_a], last_b[straight_b] = True, True
        i, j, n_a, n_b = groups.T
        last_a[i + n_a - 1], last_b[j + n_b - 1] = True, True
        # Ends of groups, in order, on both sides; every token belongs to the group that ends next.
        stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        words = np.empty(len(a) + len(b), dtype=np.int64)
        words[np.arange(len(a)) + np.concatenate(([0], stop_b))[group_a]] = a + self._last_a * last_a
        words[np.arange(len(b)) + stop_a[group_b]] = b + self._last_b * last_b
        return "".join(self._words[words].tolist())[:-1]


def _places(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of both tokens of each pair in one-to-one stretches (a, b, length)."""
    start_a, start_b, lengths = runs.T
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(start_a, lengths) + within, np.repeat(start_b, lengths) + within


def _links(ends_a: np.ndarray, ends_b: np.ndarray, straight_a: np.ndarray, straight_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of both tokens of each link outside one-to-one stretches, in order.

    Two tokens overlap in one stretch of bytes, which ends where one of them does; so there is a link for each different end.
    """
    left_a, left_b = np.ones(len(ends_a), dtype=bool), np.ones(len(ends_b), dtype=bool)
    left_a[straight_a], left_b[straight_b] = False, False
    a, b = np.flatnonzero(left_a), np.flatnonzero(left_b)
    own_a, own_b = ends_a[a], ends_b[b]
    ends = np.concatenate((own_a, own_b))
    ends.sort(kind="stable")
    if len(ends):
        ends = ends[np.concatenate(([True], ends[1:] != ends[:-1]))]
    return a[np.searchsorted(own_a, ends)], b[np.searchsorted(own_b, ends)]


@lru_cache(maxsize=1)
def vocabularies(bytes_path: str, pieces_path: str) -> Vocabularies:
    """Those of this process: tasks that follow each other in a Python worker read them once."""
    return Vocabularies(bytes_path, pieces_path)


def groups_of(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): the groups of every row as ``a1,a2|b1;a3|b2,b3`` in decimal ids; empty for texts without tokens, null and empty ones among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(bytes_path, pieces_path)
        for batch in batches:
            texts = pa.array((found[3] for found in aligner.aligned_texts(value.as_py() for value in batch.column(1))), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "groups"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, groups string")


def _blocks(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """Documents in blocks: each with the number of every pair of its in the block's dictionary, and how often it is linked there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(bytes_path, pieces_path)
        rows: list[dict] = []
        linked: list[np.ndarray] = []
        times: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            sizes = [len(x) for x in linked]
            pairs, slots = np.unique(np.concatenate(linked), return_inverse=True)
            counts = np.bincount(slots, weights=np.concatenate(times), minlength=len(pairs)).astype(np.int64)
            for row, own, n in zip(rows, np.split(slots.astype("<i4"), np.cumsum(sizes)[:-1]), times):
                row |= {"slots": own.tobytes(), "times": n.astype("<i4").tobytes()}
            value = {"block": uuid.uuid4().hex, "pairs": pairs.tolist(), "counts": counts.tolist(), "docs": list(rows)}
            rows.clear(), linked.clear(), times.clear()
            return pa.RecordBatch.from_pylist([value], schema=kind)

        for batch in batches:
            found = aligner.aligned_texts(value.as_py() for value in batch.column(1))
            for key, (n_a, n_b, count, groups, pairs) in zip(batch.column(0), found):
                digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                rows.append({"doc_id": key.as_py(), "n_a": n_a, "n_b": n_b, "n_groups": count, "n_links": len(pairs), "groups_sha256": digest})
                own, n = np.unique(pairs, return_counts=True)
                linked.append(own)
                times.append(n)
                held += len(pairs) + 1
                if held >= BLOCK_LINKS:
                    yield block()
                    held = 0
        if rows:
            yield block()

    number, text, data = pa.int64(), pa.string(), pa.binary()
    document = [("doc_id", number), ("n_a", number), ("n_b", number), ("n_groups", number), ("n_links", number), ("groups_sha256", text), ("slots", data), ("times", data)]
    kind = pa.schema([("block", text), ("pairs", pa.list_(number)), ("counts", pa.list_(number)), ("docs", pa.list_(pa.struct(document)))])
    return docs.mapInArrow(run, BLOCK)


def _rated(blocks: pa.Table, totals: pa.Table) -> pa.Table:
    """The documents of one block with the totals of their pairs. Block names are unique, so there is one row on the left."""
    order = np.argsort(totals["slot"].to_numpy())
    total, best = totals["total"].to_numpy()[order], totals["best"].to_numpy()[order]
    columns: dict[str, list] = {name.split()[0]: [] for name in RESULT.split(", ")}
    for docs in blocks["docs"]:
        for doc in docs.as_py():
            slots, times = np.frombuffer(doc.pop("slots"), "<i4"), np.frombuffer(doc.pop("times"), "<i4").astype(np.int64)
            doc |= {"n_best": int(times[best[slots]].sum()), "count_sum": int((times * total[slots]).sum())}
            for name, value in doc.items():
                columns[name].append(value)
    return pa.table(columns, schema=pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in columns]))


def link_counts(blocks: DataFrame) -> DataFrame:
    """(pair, total, best): links of each id pair in the whole corpus, and whether no pair of its B id has more."""
    totals = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total"))
    highest = totals.groupBy((F.col("pair") % PAIR).alias("b_id")).agg(F.max("total").alias("highest"))
    return totals.join(highest, F.col("pair") % PAIR == F.col("b_id")).select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def coded(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or that one of the vocabularies does not give back byte for byte (with the space in front),
    has no token: zeros and an empty string. Repeated rows are coded, and count, each; ids may be null; an empty table
    gives no row; other columns are not read. Texts of any length are coded whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialize(_blocks(rows, bytes_path, pieces_path), "aligned-blocks")
    totals = materialize(link_counts(blocks), "link-counts")
    entries = blocks.select(F.col("block").alias("own_block"), F.posexplode("pairs").alias("slot", "pair"))
    own = entries.join(totals, "pair").select("own_block", "slot", "total", "best")
    documents = blocks.select("block", "docs")
    return documents.groupBy("block").cogroup(own.groupBy("own_block")).applyInArrow(_rated, RESULT)
