"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's score is a logistic function of its hashed words; a document is toxic if at least one sentence is, so its
score is the noisy-or of its sentences: one minus the product of their complements. The gradient of the document's
loss runs through the noisy-or to the sentences, which so learn where the label comes from.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provframe.llm.common import tidy
from provframe.llm.linear import SAMPLE_ROWS, Ftrl, WordHashes, fit, held_out, labelled_sample

BITS = 20
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.5
EPOCHS, ALPHA, L1, L2, BIAS = 6, 0.5, 1.0, 0.1, -7.0
#: Words kept with their logits in each Python worker, next to the rows on their way.
CACHED_LOGITS = 300_000

#: Words, and what ends a sentence.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
ENDS = frozenset(".!?\n")
BREAK = (1 << 64) - 1
SENTENCE = re.compile(r"[^.!?\n]*[^\W\d_][^.!?\n]*")


def features(word: str) -> list[int]:
    """Buckets of a word: the whole and its beginnings, so that inflected and compounded forms share what they begin with."""
    parts = {word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)}
    return [xxhash.xxh64_intdigest(p) >> (64 - BITS) for p in sorted(parts)]


class WordFeatures:
    """Numbers words as they come and keeps their features in two arrays; sentence ends have a number of their own."""

    def __init__(self):
        self._first, self._all = array("q", [0]), array("i")

    def number(self, word: str) -> int:
        if word[0] in ENDS:
            return BREAK
        self._all.extend(features(word))
        self._first.append(len(self._all))
        return len(self._first) - 2

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of words given by number, one word after the other, and how many each has."""
        first = np.frombuffer(self._first, dtype=np.int64)
        sizes = first[words + 1] - first[words]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.frombuffer(self._all, dtype=np.int32)[np.repeat(first[words], sizes) + within], sizes


def smallest(numbers: np.ndarray) -> np.ndarray:
    """The same numbers, none of them negative, in as few bytes as they need."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def instances(texts: list[str], hashes: WordHashes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words and their values, the sentence of each, the text of each sentence; sentences without words aren't counted."""
    tokens: list[str] = []
    sizes = []
    for text in texts:
        before = len(tokens)
        tokens += TOKEN.findall(text.lower())
        tokens.append("\n")
        sizes.append(len(tokens) - before)
    values = hashes(tokens)
    ends = np.isnan(values) if values.dtype.kind == "f" else values == np.uint64(BREAK)
    words = ~ends
    words[1:] &= values[1:] != values[:-1]  # a word said again and again counts once
    place = np.cumsum(ends)[words]
    owner = np.repeat(np.arange(len(texts)), sizes)[words]
    new = np.concatenate(([True], place[1:] != place[:-1]))[: len(place)]
    return tokens, values[words], np.cumsum(new) - 1, owner[new]


def log_rest(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))."""
    return -np.logaddexp(0.0, z)


def learn(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    known, model = WordFeatures(), Ftrl(1 << BITS, ALPHA, L1, L2, BIAS)
    numbers, examples = WordHashes(known.number), []
    for text, label in zip(texts, labels):
        _, words, sentence, _ = instances([text], numbers)
        if len(words):
            found, sizes = known(words.astype(np.int64))
            at, back = np.unique(found, return_inverse=True)
            examples.append((at, smallest(back), np.repeat(smallest(sentence), sizes), label))
    del known, numbers  # not needed while the model is fitted
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)):
            at, back, sentence, label = examples[k]
            w = model.weights(at)
            z = np.bincount(sentence, weights=w[back]) + model.offset()
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
            none = float(np.exp(log_rest(z).sum()))  # probability that no sentence is toxic
            dz = -none / max(1.0 - none, 1e-9) * p if label else p
            model.update(at, w, np.bincount(back, weights=dz[sentence], minlength=len(at)), float(dz.sum()))
    return model.weights(np.arange(1 << BITS)), model.offset()


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def word_logits(self) -> WordHashes:
        """The part of a word in its sentence's logit, kept by word; nan ends a sentence."""
        return WordHashes(lambda word: float("nan") if word[0] in ENDS else float(self.weights[features(word)].sum()), np.float64, CACHED_LOGITS)

    def scores(self, texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text; score and text of each sentence."""
        _, logits, sentence, owner = instances(texts, hashes)
        z = np.bincount(sentence, weights=logits, minlength=len(owner)) + self.bias
        rest = np.bincount(owner, weights=log_rest(z), minlength=len(texts))
        return -np.expm1(rest), 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))), owner


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the labelled documents that are not held out; ``rows`` of them at most.

    Null texts count as empty and, like texts without words, teach nothing; repeated rows teach as often; labels of unknown ids and null
    labels don't count. Without any label, or on an empty table, all words weigh zero.
    """
    return Model(*fit(labelled_sample(docs, labels, "toxic", id_col, text_col, rows), 1 << BITS, learn))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, whole_row: bool = False) -> DataFrame:
    """score, predicted and offending for every row, after the columns ``keep`` (default: the id).

    ``offending`` lists the sentences with a score of at least the threshold as start:end in code points. Texts
    without words, null and empty ones included, score 0. Repeated rows are scored each; an empty table gives no row.
    With ``whole_row`` the rows are one struct column that holds the text, which so travels once.
    """
    if whole_row:
        rows = docs
        names = rows.columns
    else:
        rows = docs.select(*[F.col(c) for c in ([id_col] if keep is None else keep)], F.col(text_col).alias("scored_text"))
        names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = model.word_logits()
        for batch in batches:
            found, marks = [], []
            texts: list[str] = []
            size = 0
            column = batch.column(batch.num_columns - 1)
            if whole_row:
                column = column.field(column.type.get_field_index(text_col))
            for k, text in enumerate(column):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > 1_000_000 or k + 1 == len(column):
                    scores, each, owner = model.scores(texts, hashes)
                    bad: dict[int, list[int]] = {}
                    first = np.searchsorted(owner, np.arange(len(texts)))
                    for s in np.flatnonzero(each >= THRESHOLD):
                        bad.setdefault(int(owner[s]), []).append(int(s - first[owner[s]]))
                    found.append(scores)
                    for j, own in enumerate(texts):
                        spans = [m.span() for m in SENTENCE.finditer(own)] if j in bad else []
                        marks.append(",".join(f"{spans[s][0]}:{spans[s][1]}" for s in bad.get(j, []) if s < len(spans)))
                    texts, size = [], 0
            scores = np.concatenate(found) if found else np.zeros(0)
            own = [pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(marks, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(names))] + own, names=[*names, "score", "predicted", "offending"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])
    return rows.mapInArrow(tidy(run), (kinds + ", " if kinds else "") + "score double, predicted int, offending string")


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and offending for every row of ``docs``.

    Null and empty texts and texts without words score 0. Texts of any length are scored whole. Repeated rows are scored each, equal
    texts alike; null ids count as held out. An empty table gives no row; other columns are not read. See ``train`` for odd labels.
    """
    found = score(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), train(docs, labels, id_col, text_col))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offending")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Null and empty texts and texts without words stay. Of repeated rows and equal texts all or none stay. An empty table gives no
    row. Columns may have any name, as a row travels as one struct; ids are read for the labels only and may be null.
    """
    model = train(docs, labels, id_col, text_col)
    return score(docs.select(F.struct("*").alias("row")), model, text_col=text_col, whole_row=True).where("predicted = 0").select("row.*")
