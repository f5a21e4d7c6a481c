import zlib

import pytest

from provframe.llm import quality_classifier, toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 1), (3, 0, 0), (None, 1, 1), (4, None, None), (4, 0, 0), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator", [toxicity, quality_classifier])
@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_rows(request, labels, table, operator):
    docs = request.getfixturevalue(table)
    found = operator.classified(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in docs.collect())
    threshold = operator.THRESHOLD
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in found)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)


@pytest.mark.parametrize("operator", [toxicity, quality_classifier])
def test_no_labels(odd_docs, labels, operator):
    assert operator.classified(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    good = [(r.quality, r.score, r.predicted) for r in quality_classifier.classified(docs, labels).join(labels, "doc_id").where("held_out").collect()]
    assert sum(y == p for y, _, p in good) / len(good) > 0.97
    toxic = [(r.toxic, r.score, r.predicted) for r in toxicity.classified(docs, labels).join(labels, "doc_id").where("held_out").collect()]
    assert sum(y == p for y, _, p in toxic) / len(toxic) > 0.96
    flagged = [y for y, _, p in toxic if p]
    assert sum(flagged) / len(flagged) > 0.9


def test_offending_sentences_are_found(spark):
    clean = ["the weather is fine today", "we walk along the river", "bread and cheese for lunch", "read a book in the evening"]
    texts = [". ".join(clean[(k + j) % 4] for j in range(4)) + (". you awful nitwit go. " + clean[k % 4] if k % 3 == 0 else "") for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int")
    for r in toxicity.classified(docs, labels).join(docs, "doc_id").collect():
        parts = [r.text[int(a) : int(b)] for a, b in (s.split(":") for s in r.offending.split(",") if s)]
        assert [p.strip() for p in parts] == (["you awful nitwit go"] if r.doc_id % 3 == 0 else [])


def test_toxic_rows_go_and_others_keep_their_columns(spark, odd_docs, labels):
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.schema.names == odd_docs.schema.names
    assert kept.count() <= odd_docs.count()
