"""Quality by logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Tokens are runs of letters, of digits and of other characters, and line ends. Features are the hashed one- and two-grams of the
small-letter tokens and the one- to three-grams of their shapes (case, kind of character, whether the token repeats an
earlier neighbour), which also say something about words never seen. A document is a sparse vector of length
one; its score is the logistic function of one sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provframe.llm.linear import SAMPLE_ROWS, Ftrl, WordHashes, fit, held_out, labelled_sample

BITS = 18
THRESHOLD = 0.3
EPOCHS, ALPHA, L1, L2 = 5, 0.3, 0.3, 0.5

TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|(?:[^\w\s]|_)+")
SHAPE_BITS = 16
SHIFT = np.uint64(64 - BITS)


def _token_value(token: str) -> int:
    """Hash of the token in small letters, with its shape in the lowest bits."""
    first = token[0]
    if first.isalpha():
        shape = "AA" if token.isupper() and len(token) > 1 else "Aa" if first.isupper() else "aa"
    elif first.isdigit():
        shape = "0" * min(len(token), 8)
    else:
        shape = token[:4]
    mark = xxhash.xxh32_intdigest(shape) & ((1 << SHAPE_BITS - 1) - 1)
    return xxhash.xxh64_intdigest(token.lower()) >> SHAPE_BITS << SHAPE_BITS | mark << 1


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def features(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all texts and how many each text has; n-grams don't cross texts."""
    tokens: list[str] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        own = TOKEN.findall(text)
        tokens += own
        sizes[k] = len(own)
    values = hashes(tokens)
    word = values >> np.uint64(SHAPE_BITS)
    shape = values & np.uint64((1 << SHAPE_BITS) - 1)
    same = np.zeros(len(tokens), dtype=bool)
    same[1:] = word[1:] == word[:-1]
    shape |= same.astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    within = np.arange(len(tokens)) - first[owner]
    one, two = np.flatnonzero(within >= 1), np.flatnonzero(within >= 2)
    mixed, marked = _mix(word, 1), _mix(shape, 2)
    pairs, shapes2 = _mix(mixed[one] ^ (mixed[one - 1] >> np.uint64(3)), 3), _mix(marked[one] ^ (marked[one - 1] >> np.uint64(3)), 4)
    shapes3 = _mix(marked[two] ^ (marked[two - 1] >> np.uint64(3)) ^ (marked[two - 2] >> np.uint64(7)), 5)
    buckets = np.concatenate([mixed, marked, pairs, shapes2, shapes3]) >> SHIFT
    whose = np.concatenate([owner, owner, owner[one], owner[one], owner[two]])
    return buckets.astype(np.int64), whose


def learn(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    hashes, model = WordHashes(_token_value), Ftrl(1 << BITS, ALPHA, L1, L2)
    examples = []
    for text, label in zip(texts, labels):
        at, counts = np.unique(features([text], hashes)[0], return_counts=True)
        examples.append((at, counts / max(1.0, counts.sum()) ** 0.5, label))
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)):
            at, x, label = examples[k]
            w = model.weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x + model.offset(), -40, 40)))
            model.update(at, w, (p - label) * x, p - label)
    return model.weights(np.arange(1 << BITS)), model.offset()


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[str], hashes: WordHashes) -> np.ndarray:
        buckets, whose = features(texts, hashes)
        n = np.bincount(whose, minlength=len(texts))
        z = np.bincount(whose, weights=self.weights[buckets], minlength=len(texts)) / np.sqrt(np.maximum(n, 1)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the labelled documents that are not held out; ``rows`` of them at most."""
    return Model(*fit(labelled_sample(docs, labels, "quality", id_col, text_col, rows), 1 << BITS, learn))


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null and empty texts have no feature and score what the bias says. Repeated rows are scored each; labels without
    id or value don't count; without any label all scores are one half. An empty table gives no row. Other columns aren't read.
    """
    model = train(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(_token_value)
        for batch in batches:
            found, texts, size = [np.zeros(0)], [], 0
            for k, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > 1_000_000 or k + 1 == batch.num_rows:
                    found.append(model.scores(texts, hashes))
                    texts, size = [], 0
            scores = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
