"""Hashed linear models: labelled samples, follow-the-regularised-leader updates, mixing of shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provframe.llm.common import tidy

#: At most so many labelled documents are fitted on, so many of them in one task. Every document is scored.
SAMPLE_ROWS, SHARD_ROWS = 20_000, 5_000
#: Words kept with their hash in each Python worker.
CACHED_WORDS = 1_000_000


def held_out(doc_id: Column) -> Column:
    """True for ids whose CRC-32, as text, is divisible by five, and for null ids."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(order, text, label) of the training rows with the smallest hashes of their ids, ``rows`` ids at most.

    Rows without id or label don't count; of several labels for an id the largest does. The sample is a few columns
    of at most ``rows`` rows, so it is broadcast and no text moves.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("label")).where("label_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    chosen = known.withColumn("order", F.xxhash64("label_id")).orderBy("order", "label_id").limit(rows)
    rows_ = docs.select(F.col(id_col).cast("long").alias("sample_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows_.join(F.broadcast(chosen), F.col("sample_id") == F.col("label_id")).select("order", "text", "label")


class Ftrl:
    """Per-coordinate FTRL-proximal (McMahan et al., 2013); the last coordinate is the bias, without L1."""

    def __init__(self, size: int, alpha: float, l1: float, l2: float, bias: float = 0.0, beta: float = 1.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def offset(self) -> float:
        return self.bias - self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)

    def update(self, at: np.ndarray, w: np.ndarray, gradient: np.ndarray, bias_gradient: float) -> None:
        square = gradient * gradient
        self.z[at] += gradient - (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += square
        own = self.offset() - self.bias
        square = bias_gradient * bias_gradient
        self.z[-1] += bias_gradient - (np.sqrt(self.n[-1] + square) - np.sqrt(self.n[-1])) / self.alpha * own
        self.n[-1] += square


def fit(sample: DataFrame, size: int, learn: Callable[[list[str], list[int]], tuple[np.ndarray, float]], shard_rows: int = SHARD_ROWS) -> tuple[np.ndarray, float]:
    """Mean of the models that ``learn`` makes of each shard: ``size`` weights and a bias.

    The driver gets at most ``size`` numbers. Without labelled rows all weights are zero.
    """
    shards = max(1, -(-sample.count() // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("order", "text", "label")))]
        if rows:
            rows.sort()
            texts, labels, total = [r[1] for r in rows], [r[2] for r in rows], float(len(rows))
            del rows  # each text is held once
            weights, bias = learn(texts, labels)
            at = np.flatnonzero(weights)
            columns = [pa.array(np.append(at, size)), pa.array(np.append(weights[at], bias)), pa.array(np.full(len(at) + 1, total))]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "weight", "rows"])

    dealt = sample.withColumn("shard", F.pmod(F.xxhash64("order", F.lit(1)), F.lit(shards))).repartition(shards, "shard")
    models = dealt.select("order", "text", "label").mapInArrow(tidy(run), "at long, weight double, rows double")
    mixed = models.groupBy("at").agg(F.sum(F.col("weight") * F.col("rows")).alias("weight"), F.sum("rows").alias("rows")).toPandas()
    result, bias = np.zeros(size, dtype=np.float32), 0.0
    if len(mixed):
        total = mixed.loc[mixed["at"] == size, "rows"].sum()
        inner = mixed[mixed["at"] < size]
        result[inner["at"].to_numpy()] = inner["weight"].to_numpy() / total
        bias = float(mixed.loc[mixed["at"] == size, "weight"].sum() / total)
    return result, bias


class WordHashes:
    """A number for each word, by ``value``; those of frequent words are kept."""

    def __init__(self, value: Callable[[str], float] = lambda word: xxhash.xxh64_intdigest(word), kind: type = np.uint64, most: int = CACHED_WORDS):
        self._value, self._kind, self._known, self._most = value, kind, {}, most

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > self._most:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self._value(word)
        return np.fromiter(map(known.__getitem__, words), dtype=self._kind, count=len(words))
