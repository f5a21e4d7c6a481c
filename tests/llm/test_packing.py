import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from provframe.llm import packing
from provframe.llm.queries import WORD_VOCABULARY

WHOLE = Tokenizer.from_file(WORD_VOCABULARY)
WHOLE.encode_special_tokens = True


def check(docs, capacity):
    rows = [r.asDict() for r in packing.pack_documents(docs, WORD_VOCABULARY, capacity).collect()]
    wanted = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*WHOLE.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        wanted += [str((r.doc_id, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes()))) for k in range(0, len(ids), capacity)]
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows) == sorted(wanted)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(e <= capacity for e in ends.values())
    return rows, len(ends)


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_rows(request, table):
    check(request.getfixturevalue(table), packing.CAPACITY)


def test_given_documents_fill_their_sequences(spark):
    rows, used = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), packing.CAPACITY)
    assert used <= math.ceil(sum(r["length"] for r in rows) / packing.CAPACITY) + 1


def test_word_ids_equal_the_whole_texts_ids():
    choose = random.Random(5)
    parts = ["Hello", "world,", "ça", "É", "İ", "Σ", "ΟΔΟΣ", "é", "don't", "'re", "...", "###", " ", "\n", "\x1c", "　", "\x85", "12", "²", "中文", "<|endoftext|>", "a" * 60, "!?", "_", "K"]
    texts = ["".join(choose.choices(parts, k=choose.randint(0, 12))) for _ in range(2000)]
    found = packing.WordIds(WORD_VOCABULARY)(texts)
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids, text


def fewest(sizes, capacity):
    """Fewest sequences, by trying everything."""
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                at = rooms.index(room)
                place(k + 1, rooms[:at] + [room - sizes[k]] + rooms[at + 1 :])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_dominance_never_costs_a_sequence():
    choose = random.Random(9)
    for _ in range(300):
        capacity = choose.choice([10, 20, 30])
        sizes = sorted((choose.randint(1, capacity) for _ in range(choose.randint(1, 9))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        plan = packing.Packing(counts, capacity)
        assert plan.sequences <= fewest(sizes, capacity) + 1
        # What the rules fixed, with the best packing of the rest, is optimal.
        fixed = [s for s, _, per, bins, sequence, _ in plan.runs if sequence < plan.fixed for _ in range(per * bins)]
        rest = sizes.copy()
        for s in fixed:
            rest.remove(s)
        assert plan.fixed + fewest(rest, capacity) == fewest(sizes, capacity), (sizes, capacity)


def test_runs_depend_on_lengths_alone():
    counts = {s: 1 + s % 7 for s in range(1, 4097)}
    many = {s: n * 1_000_000 for s, n in counts.items()}
    assert len(packing.Packing(many).runs) < 3 * len(packing.Packing(counts).runs) + 4096


def test_added_tokens_spelled_in_a_text_are_one_id(spark):
    own = Tokenizer.from_file(WORD_VOCABULARY)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|>", "no, none", "<|endoftext|>\x1c<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.token_pieces(docs, WORD_VOCABULARY).collect():
        ids = np.array([*own.encode(texts[r.doc_id], add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
