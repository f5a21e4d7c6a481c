import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from provframe.llm import piece_bpe
from provframe.llm.queries import PIECES

CODER = piece_bpe.PieceCoder(PIECES)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
PARTS = ["a", "the", " ", "  ", "\n", "\t", "x" * 9, "é", "́", "▁", "中", "<s>", "<0x41>", "\x00", "１", "...", "tion", " re", "😀"]


def ids(text):
    return np.frombuffer(CODER.encode(text), dtype="<u4").tolist()


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=50), st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.lists(st.sampled_from(sorted(CODER._id)), max_size=6).map("".join)))
def test_table_equals_the_library(text):
    assert ids(text) == MODEL.encode(text)
    assert CODER.decode(ids(text)) == MODEL.decode(MODEL.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12))
def test_any_ids_decode_as_in_the_library(tokens):
    assert CODER.decode(tokens) == MODEL.decode(tokens)


def test_compatibility_equals_merging_both_anew():
    dealt = random.Random(5)
    pieces = sorted(CODER._id)
    inner = [p for p in pieces if not p.startswith("▁")]
    for _ in range(5000):
        left, right = dealt.choice(pieces), dealt.choice(inner)
        assert CODER.compatible(left, right) == (CODER.merged(left + right) == [left, right])


def test_long_texts_are_coded_whole():
    for text in ("x" * 70_000, "lol" * 20_000, "中" * 5000, " " * 5000, "a" * 3000 + " " * 3000 + "b"):
        assert ids(text) == MODEL.encode(text)


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
@pytest.mark.parametrize("digests", [False, True])
def test_rows(request, table, digests):
    docs = request.getfixturevalue(table)
    wanted = []
    for r in docs.collect():
        tokens = MODEL.encode(r.text or "")
        decoded = MODEL.decode(tokens) if tokens else ""
        if digests:
            wanted.append((str(r.doc_id), len(tokens), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, tokens)), decoded))))
        else:
            wanted.append((str(r.doc_id), len(tokens), np.array(tokens, dtype="<u4").tobytes(), decoded))
    found = piece_bpe.coded(docs, PIECES, digests=digests).collect()
    assert sorted((str(r[0]), r[1], r[2] if digests else bytes(r[2]), r[3]) for r in found) == sorted(wanted)
