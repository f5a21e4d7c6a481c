import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from provframe.llm import bpe
from provframe.llm.queries import BYTE_RANKS

SMALL = bpe.TreeCoder(BYTE_RANKS, public_tokenizers.PATTERN, leaf_chars=3)
WHOLE: tiktoken.Encoding = SMALL._merges
PARTS = ["a", "b", " ", "  ", "\n", "'", "re", "'ll", "1", "²", "é", "̈", "\x1c", "\x85", "　", "!", "中", "\t", "\r\n", "'s", "_"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=60).map("".join)))
def test_tree_equals_whole_and_decodes_to_the_text(text):
    ids = SMALL.encode(text)
    assert ids == np.array(WHOLE.encode_ordinary(text), dtype="<u4").tobytes()
    assert SMALL.decode(ids) == text.encode()


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_rows(request, table):
    docs = request.getfixturevalue(table)
    found = sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.coded(docs, BYTE_RANKS, public_tokenizers.PATTERN).collect())
    wanted = []
    for r in docs.collect():
        ids = WHOLE.encode_ordinary(r.text or "")
        wanted.append((str(r.doc_id), len(ids), np.array(ids, dtype="<u4").tobytes(), (r.text or "").encode()))
    assert found == sorted(wanted)
