import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from provframe.llm import alignment
from provframe.llm.queries import BYTE_VOCABULARY, PIECES, op11_alignment

from ..conftest import SF_SMALL

ALIGNER = alignment.Aligner(BYTE_VOCABULARY, PIECES)
BYTES = Tokenizer.from_file(BYTE_VOCABULARY)
BYTES.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
PARTS = ["a", "the", " ", "  ", "\n", "\t", "x" * 9, "é", "́", "▁", "中", "<s>", "<|endoftext|>", "'ll", "12", "²", "...", "tion", " re", "\x1c", "😀"]


def brute(text):
    """(tokens A, tokens B, groups, links): every pair of tokens is looked at."""
    if not text:
        return 0, 0, [], []
    a, b = BYTES.encode(" " + text, add_special_tokens=False).ids, MODEL.encode(text)
    parts = [[vocabulary[k] for k in tokens] for vocabulary, tokens in ((ALIGNER.tokens_a, a), (ALIGNER.tokens_b, b))]
    if any(b"".join(p) != b" " + text.encode() for p in parts):
        return 0, 0, [], []
    ends = [np.cumsum([len(t) for t in p]).tolist() for p in parts]
    links = [
        (x, y)
        for x, end_a, part_a in zip(a, ends[0], parts[0])
        for y, end_b, part_b in zip(b, ends[1], parts[1])
        if max(end_a - len(part_a), end_b - len(part_b)) < min(end_a, end_b)
    ]
    groups, start = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append("|".join(",".join(str(t) for t, e in zip(tokens, own) if start < e <= cut) for tokens, own in ((a, ends[0]), (b, ends[1]))))
        start = cut
    return len(a), len(b), groups, links


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)))
def test_groups_and_links_equal_brute_force(text):
    n_a, n_b, count, groups, pairs = ALIGNER.align(text)
    wanted = brute(text)
    assert (n_a, n_b, count, groups) == (wanted[0], wanted[1], len(wanted[2]), ";".join(wanted[2]))
    assert sorted(pairs.tolist()) == sorted(x * alignment.PAIR + y for x, y in wanted[3])


def test_links_of_irregular_tokens_are_found_at_once():
    """Each different end outside one-to-one stretches is one link."""
    ends_a, ends_b = np.array([1, 4, 6, 9, 12, 15]), np.array([1, 3, 5, 9, 12, 13, 15])
    straight = np.array([0, 4]), np.array([0, 4])
    a, b = alignment._links(ends_a, ends_b, *straight)
    assert list(zip(a.tolist(), b.tolist())) == [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (5, 5), (5, 6)]
    none = alignment._links(ends_a[:1], ends_b[:1], np.array([0]), np.array([0]))
    assert [len(x) for x in none] == [0, 0]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3), st.integers(0, 12)), max_size=12))
def test_stretches_cover_both_arrays(shape):
    """Irregular groups of any size between one-to-one runs of any length."""
    ends_a, ends_b, at, groups = [], [], 0, []
    for n_a, n_b, run in shape:
        own_a = [at + 2 * (k + 1) for k in range(n_a - 1)] + [at + 20]
        own_b = [at + 2 * k + 1 for k in range(1, n_b)] + [at + 20]
        groups.append((n_a, n_b))
        ends_a += own_a + [at + 20 + k for k in range(1, run + 1)]
        ends_b += own_b + [at + 20 + k for k in range(1, run + 1)]
        groups += [(1, 1)] * run
        at += 20 + run
    found = []
    for _, _, n_a, n_b, single in alignment.aligned(np.array(ends_a, dtype=np.int64), np.array(ends_b, dtype=np.int64)):
        found += [(1, 1)] * n_a if single else [(n_a, n_b)]
    assert found == groups


def expected(rows):
    linked = {k: brute(text) for k, (_, text) in enumerate(rows)}
    counts = Counter(pair for w in linked.values() for pair in w[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for k, (key, _) in enumerate(rows):
        n_a, n_b, groups, links = linked[k]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        best = sum(counts[pair] == highest[pair[1]] for pair in links)
        out.append((str(key), n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return sorted(out)


def collected(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r["doc_id"]), *(r[n] for n in names[1:])) for r in df.collect())


@pytest.mark.parametrize("block_links", [alignment.BLOCK_LINKS, 40])
def test_corpus_counts_equal_brute_force(spark, monkeypatch, block_links):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", block_links)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("length(text) < 1500")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert collected(alignment.coded(docs.repartition(3), BYTE_VOCABULARY, PIECES)) == expected(rows)


def test_odd_rows(odd_docs, no_docs):
    docs = odd_docs.where("text IS NULL OR length(text) < 1000")
    assert collected(alignment.coded(docs, BYTE_VOCABULARY, PIECES)) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert alignment.coded(odd_docs, BYTE_VOCABULARY, PIECES).count() == odd_docs.count()
    assert alignment.coded(no_docs, BYTE_VOCABULARY, PIECES).count() == 0
    groups = {str(r.doc_id): r.groups for r in alignment.groups_of(docs, BYTE_VOCABULARY, PIECES).collect()}
    assert groups["4"] == ";".join(brute("one two")[2]) and groups["0"] == ""


def test_query_covers_all_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    found = op11_alignment(spark, SF_SMALL)
    assert found.count() == docs.count()
    assert found.where("n_links != n_a + n_b - n_groups OR n_best > n_links").count() == 0


WORDS = [f" w{k}x" for k in range(700)] + ["\nline", " two  spaces", " end.", "\n(", " é", " ŉ", " ĳ", " ſt", "  wide", " open ", "中文", " x" * 30, " <s>"]


def test_fresh_parts_are_encoded_in_rows(monkeypatch):
    """As one by one, but in few calls; parts that one of the vocabularies changes don't spoil those beside them."""
    aligner = alignment.Aligner(BYTE_VOCABULARY, PIECES)
    calls, plain = [], aligner._plain
    monkeypatch.setattr(aligner, "_plain", lambda text: calls.append(text) or plain(text))
    assert aligner._encode(WORDS[:700]) == alignment.Aligner(BYTE_VOCABULARY, PIECES)._encode_each(WORDS[:700])
    assert len(calls) == -(-700 // alignment.ROW)
    for parts in (WORDS, WORDS[::-1], WORDS[690:], [" ŉ"], []):
        assert aligner._encode(parts) == aligner._encode_each(parts)


def test_tasks_of_a_worker_share_the_vocabularies():
    other = alignment.Aligner(BYTE_VOCABULARY, PIECES)
    assert other.tokens_a is ALIGNER.tokens_a and other._pieces is ALIGNER._pieces
    assert other._known is not ALIGNER._known
