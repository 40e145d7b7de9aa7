"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL-proximal updates.

Words are runs of letters and digits and runs of symbols; their unigrams and bigrams are hashed into
2^18 weights. A document is the sparse vector of its n-gram shares; its score is the logistic of one
sparse dot product, so long and short texts score on one scale and whole texts are read.

The model is fitted in one task on at most ``SAMPLE`` labelled rows (a documented bound; the rows with the
smallest hashes), which that task reads as a stream, ``EPOCHS`` times over. Every row is then scored where
it lies; only the weights (1 MB) travel.

Defined results: null and empty texts have no n-grams and score the logistic of the intercept; labels that
are null are not learned from; repeated labels and repeated rows of an id count once; without labelled rows, or with one class only,
the model is what the updates make of them (0.5 for none); a null ``doc_id`` is held out like the text ''.
Only ``doc_id``, ``text`` and the label are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.llm import tokens
from visitlens.llm.common import read, small_batches

BITS = 18
SAMPLE, EPOCHS = 6000, 3
#: Fixed values of the query contract.
FOLDS, THRESHOLD = 5, 0.3
#: Shares of n-grams are small; scaled by this the usual learning rates fit.
SCALE = 8.0
#: The bigram of a word and itself.
SAME = np.uint64(0x5A4D)


class Ftrl:
    """FTRL-proximal with per-weight learning rates and L1 / L2 penalties."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """``at`` has distinct places."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


class Model(NamedTuple):
    weights: np.ndarray  #: the last is the intercept
    bits: int


def _features(texts: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, places, bounds) by slice: row ``k``'s n-grams are ``places[bounds[k]:bounds[k + 1]]``."""
    mask = np.uint64((1 << bits) - 1)
    for first, h, at in tokens.slices(texts, tokens.run_classes()):
        # A word after itself is one n-gram whatever the word, so that stuttering is learned as such.
        pairs = np.where(h[:-1] == h[1:], SAME, tokens.mix(h[:-1] * np.uint64(3) + h[1:]))
        own = np.zeros((len(h), 2), np.int64)
        own[:, 0] = (h & mask).astype(np.int64)
        last = np.zeros(len(h) + 1, bool)
        last[at[1:]] = True  # the token before a row's end begins no pair
        has = ~last[1:]
        own[:-1, 1] = (pairs & mask).astype(np.int64)
        held = np.ones((len(h), 2), bool)
        held[:, 1] = has
        if len(h):
            held[-1, 1] = False
        bounds = np.concatenate([[0], np.cumsum(held.sum(axis=1))])[at]
        yield first, own[held], bounds


def fit(labelled: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, bits: int = BITS) -> Model:
    """Model from ``labelled`` (``doc_id``, ``text``, ``label`` 0/1), a bounded sample chosen by ``sampled``."""
    order = F.xxhash64("doc_id", "text", "label")
    rows = labelled.select("text", "label", order.alias("turn"), F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    rows = rows.repartition(1).sortWithinPartitions("epoch", "turn")
    size = (1 << bits) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Ftrl(size)
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for first, places, bounds in _features(batch.column(0), bits):
                for k in range(len(bounds) - 1):
                    own = places[bounds[k] : bounds[k + 1]]
                    at, count = np.unique(own, return_counts=True)
                    f.update(np.append(at, size - 1), np.append(count * (SCALE / max(len(own), 1)), 1.0), int(labels[first + k]))
        w = f.weights()
        at = np.flatnonzero(w)
        yield pa.record_batch({"place": pa.array(at, pa.int64()), "weight": pa.array(w[at], pa.float64())})

    weights = np.zeros(size, np.float32)
    for r in rows.select("text", "label").mapInArrow(run, "place bigint, weight double").collect():
        weights[r["place"]] = r["weight"]
    return Model(weights, bits)


def sampled(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text, label`` of at most ``sample`` labelled rows: those with the smallest hashes of the id.

    The labels are cut down first, so the join that fetches the texts broadcasts a bounded table.
    """
    chosen = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one row a pair, however often an id is repeated


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score`` of every document."""
    rows = small_batches(docs).select(*keep, *([] if "text" in keep else ["text"]))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, places, bounds in _features(batch.column("text"), model.bits):
                total = np.concatenate([[0.0], np.cumsum(model.weights[places], dtype=np.float64)])
                count = np.diff(bounds)
                dot = (total[bounds[1:]] - total[bounds[:-1]]) * SCALE / np.maximum(count, 1)
                out[first : first + len(count)] = 1 / (1 + np.exp(-np.clip(dot + model.weights[-1], -30, 30)))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(out)], names=[*keep, "score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == 0


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model of the labels that are not held out."""
    return fit(sampled(docs, labels.where(~held_out(F.col("doc_id"))), label))


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be good, with their own columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(rows, model, ("row",)).where(F.col("score") >= THRESHOLD).select("row.*")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, learned(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))
