import hashlib
import random

import numpy as np
import pytest

from provframe.llm import substring_dedup


def brute(rows):
    """rows of (id, text): by a dictionary of all 50-byte strings."""
    order = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in order:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            least[s] = min(i, least.get(s, i))
    found = []
    for (i, b), (own, _) in zip(order, rows):
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        found.append(str((own, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(found)


def check(docs):
    found = sorted(str(tuple(r)) for r in substring_dedup.without_repeats(docs).collect())
    assert found == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_rows(request, table):
    check(request.getfixturevalue(table))


def generated():
    choose = random.Random(11)
    word = lambda: "".join(choose.choices("abcé", k=choose.randint(1, 6)))
    passages = [" ".join(word() for _ in range(n)) for n in (8, 14, 15, 30, 90)] + ["ab" * 60, "x" * 49, "y" * 50, "z" * 51]
    texts = []
    for _ in range(150):
        texts.append(" ".join(choose.choice(passages) if choose.random() < 0.3 else word() for _ in range(choose.randint(1, 30))))
    return list(enumerate(texts + texts[:5] + [texts[7][1:], texts[8][:-1]]))


@pytest.mark.parametrize("many", [20_000, 3])
def test_generated(spark, monkeypatch, many):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    monkeypatch.setattr(substring_dedup, "SORTED_AT_ONCE", 50)
    check(spark.createDataFrame(generated(), "doc_id long, text string").repartition(5))


def test_given_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3))


def test_a_task_holds_one_bucket_of_names(spark):
    """Samples of a bucket are settled as soon as the next bucket begins, whatever a task has of the others."""
    read = []

    def batches():
        for bucket in (0, 0, 3, 7):
            read.append(bucket)
            names, docs, keys, places = (np.array(x, dtype=t).tobytes() for x, t in (([5, 6], "<u8"), ([len(read), 9], "<i8"), ([1, 1], "<i8"), ([4, 8], "<i4")))
            yield substring_dedup._batch([bucket], [[names], [docs], [keys], [places]])

    found = substring_dedup._shared_samples(batches())
    first = next(found)
    assert read == [0, 0, 3]
    assert sorted(zip(first.column(0).to_pylist(), (np.frombuffer(x, "<i4").tolist() for x in first.column(2).to_pylist()))) == [(1, [4]), (2, [4])]
    assert [b.num_rows for b in found] == [0, 0] and read == [0, 0, 3, 7]


def test_more_buckets_than_tasks(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(12)]
    rows = [(i, texts[i % 12][i * 7 :] + texts[(i * 5 + 1) % 12][: 300 + i]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(tuple, substring_dedup.without_repeats(docs).collect()))
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 500)
    assert sorted(map(tuple, substring_dedup.without_repeats(docs).collect())) == few
    assert sum(r[2] for r in few) > 0
