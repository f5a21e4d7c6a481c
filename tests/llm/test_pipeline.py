import tracemalloc
import weakref

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provframe.llm import common, linear, packing, queries, simhash, toxicity
from provframe.llm.common import materialize, read_table
from tests.llm.test_pii import brute as pii_brute
from tests.llm.test_simhash import brute_components, brute_fingerprint

FOLDER = "/root/testdata/sf0.01"


def test_stages_follow_brute_force(spark):
    docs = read_table(spark, FOLDER, "documents")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), name)
        after[name] = docs
    names = read_table(spark, FOLDER, "documents").columns
    assert all(d.columns == names for d in list(after.values())[:-1])

    texts = {r.doc_id: r.text for r in read_table(spark, FOLDER, "documents").collect()}
    scores = toxicity.classified(read_table(spark, FOLDER, "documents"), read_table(spark, FOLDER, "labels")).collect()
    left = {r.doc_id for r in scores if not r.predicted}
    assert {r.doc_id for r in after["toxicity"].collect()} == left

    best = {}
    for i in sorted(left):
        key = "".join(texts[i].encode().translate(None, b" \t\n\v\f\r").decode())
        if key not in best or len(texts[i]) > len(texts[best[key]]):
            best[key] = i
    left = sorted(best.values())
    assert sorted(r.doc_id for r in after["exact_dedup"].collect()) == left

    left = sorted(set(brute_components([brute_fingerprint(texts[i]) for i in left], left)))
    assert sorted(r.doc_id for r in after["simhash_near_dedup"].collect()) == left

    clean = {r.doc_id: r for r in after["pii"].collect()}
    assert sorted(clean) == left
    for i in left:
        if sum(pii_brute(texts[i])[0][:4]):
            assert clean[i].text != texts[i] and clean[i].n_chars == len(clean[i].text)
        else:
            assert clean[i].text == texts[i]
    packed = after["packing"].collect()
    assert {r.doc_id for r in packed} == set(left)
    assert sum(r.length for r in packed) == sum(len(x) // 4 + 1 for x in packing.WordIds(queries.WORD_VOCABULARY)([clean[i].text for i in left]))


def test_every_dealt_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("rows", [True, False])
def test_the_whole_chain_takes_odd_rows_and_empty_tables(spark, odd_docs, tmp_path, rows):
    docs = odd_docs.where("text IS NULL OR length(text) < 60000").select("doc_id", "text", "lang", F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
    if not rows:
        docs = docs.limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (4, None, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Null and white space are one text, "one two" and "One  two" another; the 9,000 words are cut into pieces of 4,096 tokens.
    pieces = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.length))
    assert sorted(pieces, key=str) == ([2, 3, 4, 7, 8] if rows else [])
    assert all(sorted(n for n, _ in p) == list(range(len(p))) for p in pieces.values())


def test_memory_goes_back_after_a_task(monkeypatch):
    """Once the rows are through, and what the task held is free."""

    class Held:
        pass

    seen = []

    def run(batches):
        held = Held()
        seen.append(weakref.ref(held))
        yield from batches

    monkeypatch.setattr(common, "give_back", lambda: seen.append(seen[0]()))
    rows = common.tidy(run)(iter([1, 2]))
    assert next(rows) == 1 and len(seen) == 1
    assert list(rows) == [2] and seen[1:] == [None]
    monkeypatch.undo()
    common.give_back()


def test_stages_in_python_tidy_up(spark, monkeypatch):
    tidied = []
    for module in (simhash, toxicity, packing, linear):
        monkeypatch.setattr(module, "tidy", lambda run, name=module.__name__: tidied.append(name) or run)
    docs, labels = (read_table(spark, FOLDER, name).limit(30) for name in ("documents", "labels"))
    toxicity.drop_toxic(docs, labels)
    simhash.drop_near_copies(docs)
    packing.token_pieces(docs, queries.WORD_VOCABULARY)
    assert {name.rsplit(".", 1)[1] for name in tidied} == {"simhash", "toxicity", "packing", "linear"}


def test_learning_holds_words_in_arrays(monkeypatch):
    """Bytes at the peak for each different word, beside a small model: 159 now, 469 with lists of numbers."""
    monkeypatch.setattr(toxicity, "BITS", 12)
    texts = [" ".join(f"{a}{b}word{chr(97 + k % 26)}{chr(97 + k // 26)}." for k in range(60)) for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmno"]
    toxicity.learn(texts[:1], [1])
    tracemalloc.start()
    try:
        toxicity.learn(texts, [k % 2 for k in range(len(texts))])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 300 * 60 * len(texts)
