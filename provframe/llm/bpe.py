"""Byte-level BPE as a monoid: halves are encoded on their own and joined by re-encoding a window around the seam.

An element of the monoid is a stretch of text with its pattern matches and their ids, as if the stretch stood alone. Two
neighbours are joined by splitting a window around the seam anew, which grows until what lies outside is proved
to stay:

* A match is decided by its own characters and at most two more, so in the left part all matches that end two characters
  before the seam stay as they are, whatever follows.
* The pattern looks only forward. Once the new split has a boundary, again two characters before the window's
  end, where the right part has one too, both go on alike.

The merges of a match don't reach beyond it, so its ids stay with it. Decoding concatenates the bytes of token blocks
up a tree in the same way.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf, tokens of a leaf when decoding, characters by which a match can be undecided.
LEAF_CHARS, LEAF_TOKENS, UNDECIDED = 2048, 1024, 2
#: Matches kept with their ids in each Python worker, and the longest such match.
CACHED, CACHED_CHARS = 1_000_000, 48


class TreeCoder:
    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(ranks_path, "rb") as lines:  # part of the tokenizer's installation on every machine
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._split = regex.compile(pattern).findall
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._known: dict[str, bytes] = {}
        self._leaf = leaf_chars

    def _ids(self, matches: list[str]) -> list[bytes]:
        known = self._known
        try:
            return list(map(known.__getitem__, matches))
        except KeyError:
            pass
        if len(known) > CACHED:
            known.clear()
        result = []
        for match in matches:
            ids = known.get(match)
            if ids is None:
                ids = np.array(self._merges.encode_ordinary(match), dtype="<u4").tobytes()
                if len(match) <= CACHED_CHARS:
                    known[match] = ids
            result.append(ids)
        return result

    def _tree(self, text: str, low: int, high: int) -> tuple[list[str], list[bytes]]:
        if high - low <= self._leaf:
            matches = self._split(text[low:high])
            return matches, self._ids(matches)
        middle = (low + high) // 2
        return self._join(self._tree(text, low, middle), self._tree(text, middle, high))

    def _join(self, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        (before, ids_before), (after, ids_after) = left, right
        width = 2
        while True:
            tail, head = before[-width:], after[:width]
            whole_left, whole_right = width >= len(before), width >= len(after)
            seam = sum(map(len, tail))
            if whole_left or seam >= UNDECIDED:
                window = "".join(tail) + "".join(head)
                sure = len(window) if whole_right else len(window) - UNDECIDED
                boundaries, at = {seam: 0}, seam
                for k, match in enumerate(head, 1):
                    at += len(match)
                    boundaries[at] = k
                at, fresh = 0, self._split(window)
                for n, match in enumerate(fresh, 1):
                    at += len(match)
                    if at > sure:
                        break
                    if (k := boundaries.get(at)) is not None:
                        keep = len(before) - len(tail)
                        return before[:keep] + fresh[:n] + after[k:], ids_before[:keep] + self._ids(fresh[:n]) + ids_after[k:]
            width *= 2

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return b"".join(self._tree(text, 0, len(text))[1])

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, dtype="<u4").tolist()
        parts = [b"".join(map(self._bytes.__getitem__, tokens[k : k + LEAF_TOKENS])) for k in range(0, len(tokens), LEAF_TOKENS)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def coded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row; ids as bytes of little-endian 32-bit integers, decoded as bytes.

    With ``digests`` the two byte columns give way to ids_sha256 and decoded_sha256. Null and empty texts have no token.
    Repeated rows are coded each; ids may be null; an empty table gives no row; other columns are not read.
    """
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TreeCoder(ranks_path, pattern)
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                decoded = coder.decode(ids)
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                second.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
            kind = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, kind), pa.array(second, kind)], names=names)

    kind = "string" if digests else "binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, {names[2]} {kind}, {names[3]} {kind}")
