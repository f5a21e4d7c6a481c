"""SentencePiece BPE encoding by a prefix table of last tokens, and decoding.

The merges of such a model are those of its pieces: two neighbours merge when their concatenation is a piece, the
piece with the best score first, the leftmost first among equals. Then every prefix of a text ends in exactly one token of
the prefix's own encoding, and a token sequence is an encoding just when all its neighbours are compatible, that is when
encoding the two alone gives the two back. So one pass over the matches of an automaton over all pieces fills a table
"last token of each prefix": of the pieces ending there, the one that is compatible with the last token of the prefix
before it. The ids are read off backwards.

Characters of no piece stand alone and become byte tokens. No piece holds white space after anything else, so a text
falls apart before white space, and frequent parts keep their ids.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provframe.llm.common import Recent

#: Fixed value: the character that stands for a space in pieces.
SPACE = "▁"
#: Parts met recently that each Python worker keeps with their ids (twice as many at most), and the longest such part.
CACHED, CACHED_CHARS = 250_000, 40
#: Compatibility of token pairs kept in each Python worker.
CACHED_PAIRS = 2_000_000
#: Whether the machine's own integers are those of the packed ids.
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: What a decoder writes for the unknown token, and for a byte that is no UTF-8.
UNKNOWN, NO_TEXT = " ⁇ ", "�"


class PieceCoder:
    """Encodes and decodes with one model file. Scores must fall from merge to merge, as in every trained BPE model."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(k) for k in range(size)]
        self._byte_ids = [0] * 256
        #: Bytes of each id in a decoded text; None for ids that stand for no text of their own.
        self.surfaces: list[bytes | None] = [None] * size
        self._control = {k for k in range(size) if model.is_control(k)}
        self._bytes_of: dict[int, int] = {}
        normal: dict[str, int] = {}
        for k, piece in enumerate(self.pieces):
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self._byte_ids[value] = k
                self._bytes_of[k] = value
                self.surfaces[k] = bytes([value])
            elif not model.is_control(k) and not model.is_unknown(k) and not model.is_unused(k):
                normal[piece] = k
                self.surfaces[k] = piece.replace(SPACE, " ").encode()
        if len(self._bytes_of) != 256:
            raise ValueError("the model has no byte fallback")
        if any(SPACE in piece.lstrip(SPACE) for piece in normal):
            raise ValueError("the model has pieces with white space inside")
        self._id = normal
        #: Lower ranks merge first.
        self._rank = {piece: -model.get_score(k) for piece, k in normal.items()}
        alphabet = {c for piece in normal for c in piece}
        self._automaton = ahocorasick.Automaton()
        self._lefts: dict[str, list[tuple[str, float]]] = {}
        self._rights: dict[str, list[tuple[str, float]]] = {}
        splits: dict[str, tuple[str, str] | None] = {}
        for piece in sorted(alphabet | set(normal), key=len):
            merged = self.merged(piece)
            if len(merged) == 1:
                self._automaton.add_word(piece, piece)
            splits[piece] = self._last_split
        for piece in splits:
            self._rights[piece] = self._ends(piece, splits, 1)
            self._lefts[piece] = self._ends(piece, splits, 0)
        self._automaton.make_automaton()
        alone = "".join(re.escape(c) for c in map(chr, [*range(32), *range(127, 160)]) if c not in alphabet)
        self._parts = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]").findall
        self._compatible: dict[tuple[str, str], bool] = {}
        self._known = Recent(CACHED)

    _last_split: tuple[str, str] | None = None

    def merged(self, text: str) -> list[str]:
        """The merges done one by one: what the prefix table replaces; used for single pieces, and in tests."""
        parts, rank, self._last_split = list(text), self._rank, None
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], np.inf))
            left, right = parts[best], parts[best + 1]
            if left + right not in rank:
                break
            self._last_split = (left, right)
            parts[best : best + 2] = [left + right]
        return parts

    def _ends(self, piece: str, splits: dict[str, tuple[str, str] | None], side: int) -> list[tuple[str, float]]:
        """The tokens that stand at one end of a piece as its merges are undone, each with the rank of the merge that ends it."""
        found, until = [], np.inf
        while True:
            found.append((piece, until))
            split = splits[piece]
            if split is None:
                return found
            until = self._rank[piece]
            piece = split[side]

    def compatible(self, left: str, right: str) -> bool:
        """Whether encoding the two together gives the two: at no time do their touching ends merge with each other."""
        known = self._compatible.get((left, right))
        if known is not None:
            return known
        rank, result = self._rank, True
        ends, starts = self._rights[left], self._lefts[right]
        i = j = 0
        while True:
            (end, end_until), (start, start_until) = ends[i], starts[j]
            merge = rank.get(end + start)
            # A merge of the same rank farther left goes first, one farther right does not.
            if merge is not None and merge < end_until and merge <= start_until:
                result = False
                break
            born_end = ends[i + 1][1] if i + 1 < len(ends) else -np.inf
            born_start = starts[j + 1][1] if j + 1 < len(starts) else -np.inf
            if born_end == born_start == -np.inf:
                break
            if born_end > born_start:
                i += 1
            else:
                j += 1
        if len(self._compatible) > CACHED_PAIRS:
            self._compatible.clear()
        self._compatible[left, right] = result
        return result

    def _table(self, part: str) -> list[str | None]:
        """The last token of every prefix; None where the prefix ends in a character of no piece, or is empty."""
        last: list[str | None] = [None] * (len(part) + 1)
        known, compatible = self._compatible, self.compatible
        done = -1
        for at, token in self._automaton.iter(part):
            if at != done:
                before = last[at + 1 - len(token)]
                if before is None:
                    last[at + 1], done = token, at
                else:
                    fits = known.get((before, token))
                    if compatible(before, token) if fits is None else fits:
                        last[at + 1], done = token, at
        return last

    def _encode_part(self, part: str) -> bytes:
        last, end, ids = self._table(part), len(part), []
        own_ids = self._id
        while end:
            token = last[end]
            own = own_ids.get(token)
            if own is None:
                ids.extend(self._byte_ids[b] for b in reversed((token or part[end - 1]).encode()))
                end -= len(token or " ")
            else:
                ids.append(own)
                end -= len(token)
        ids.reverse()
        return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts, known = self._parts(SPACE + text.replace(" ", SPACE)), self._known
        found = [known[p] for p in parts]
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    part = parts[k]
                    found[k] = ids = known[part] or self._encode_part(part)
                    if len(part) <= CACHED_CHARS:
                        known.keep(part, ids)
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, without the space that encoding puts in front."""
        try:
            text = b"".join(map(self.surfaces.__getitem__, ids)).decode()
        except (TypeError, UnicodeDecodeError):
            text = self._decode_odd(ids)
        if ids and self.pieces[next((k for k in ids if k not in self._control), 0)].startswith(SPACE):
            text = text[1:]
        return text

    def _decode_odd(self, ids: list[int]) -> str:
        """Decoding with control and unknown tokens, or with byte tokens that are no UTF-8."""
        parts, held = [], bytearray()
        for k in [*ids, None]:
            if k is not None and k in self._bytes_of:
                held.append(self._bytes_of[k])
                continue
            while held:
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(held[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    parts.append(NO_TEXT)
                del held[:n]
            if k is not None and k not in self._control:
                surface = self.surfaces[k]
                parts.append(UNKNOWN if surface is None else surface.decode())
        return "".join(parts)


def coded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row; ids as bytes of little-endian 32-bit integers, decoded as text.

    With ``digests`` the two columns give way to ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256. The model file
    is part of the tokenizer's installation on every machine. Null and empty texts have no token. Repeated rows are coded
    each; ids may be null; an empty table gives no row; other columns are not read. Texts of any length are coded whole.
    """
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = (pa.string(), pa.string()) if digests else (pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(model_path)
        decimal = [str(k) for k in range(len(coder.pieces))]
        for batch in batches:
            counts, first, second = [], [], []
            for value in batch.column(1):
                packed = coder.encode(value.as_py() or "")
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                decoded = coder.decode(ids)
                counts.append(len(ids))
                first.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest() if digests else packed)
                second.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names=names)

    schema = f"doc_id long, n_tokens long, {names[2]} {'string' if digests else 'binary'}, {names[3]} string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
