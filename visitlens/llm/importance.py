"""Importance resampling towards a target distribution, on hashed word n-grams.

A byte table lower-cases A-Z and blanks the separators of a UTF-8 text, ``bytes.split`` yields its words, and
CRC-32 sums are chained from word to word: the sum of "a b c" goes on from that of "a b". Features are the runs
of 1 to 3 words, hashed into 10,000 buckets. All documents and all target texts are counted by bucket; a
bucket's gain is the logarithm of its smoothed share in the target over that in the documents, a document's
weight the sum of its features' gains, and the documents with the highest weight plus Gumbel noise are drawn,
which samples without replacement in proportion to the weights.

Counts of a bucket are summed in the map tasks; only the 10,000 sums reach the driver and only the gains
(80 KB) travel back. Ranks come from one range partitioning of the small columns: rows are numbered within
their partition, and the sizes of the partitions before are added.

Defined results: null, empty and word-less texts have no features and weight 0; the noise of a null ``doc_id``
is that of the text ''; ties go to the smaller ``doc_id`` (null first), repeated ids further by features, and
rows equal in all of these rank in any order; without target texts every gain is that of t = 0; empty tables
give no rows. Only ``doc_id`` and ``text`` are read, so other columns cannot clash; whole texts are read in
pieces.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import persisted, read, small_batches
from visitlens.llm.pieces import pieces, translation

#: Fixed values of the query contract.
BUCKETS, LONGEST, SEED = 10_000, 3, 42
LEAST_WORDS, DRAWN_PERCENT = 20, 5

WORDS = translation("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _buckets(text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the features that end there) by piece of a text."""
    before: list[list[int]] = [[] for _ in range(LONGEST - 1)]  # sums of the runs that end in the last word
    for words in pieces(text or b"", WORDS):
        if not words:
            continue
        runs = list(map(crc32, words))
        sums = [np.array(runs, np.uint32)]
        ends = [runs[-1:]]
        for n in range(1, LONGEST):
            heads = before[n - 1] + runs[:-1]  # runs of n words that end just before a word of this piece
            runs = list(map(crc32, words[len(words) - len(heads) :], map(crc32, repeat(b" "), heads)))
            sums.append(np.array(runs, np.uint32))
            ends.append(runs[-1:])
        before = ends[:-1]
        yield len(words), np.concatenate(sums) % BUCKETS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[int] = Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            for _, buckets in _buckets(text.as_py()):
                counts.update(buckets.tolist())
    yield pa.record_batch({"bucket": pa.array(counts.keys(), pa.int32()), "n": pa.array(counts.values(), pa.int64())})


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features by bucket over all rows of ``texts``; at most ``BUCKETS`` sums are collected."""
    parts = small_batches(texts).select("text").mapInArrow(_counted, "bucket int, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Per bucket ``floor(1000 * ln(share in target / share in source))`` with one added to each count."""
    t_all, s_all = int(target.sum()) + BUCKETS, int(source.sum()) + BUCKETS
    pairs = zip(target.tolist(), source.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for t, s in pairs], np.int64)


def noise(doc_id: int | str | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    rows = small_batches(docs).select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint, score bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((4, batch.num_rows), np.int64)
            ids = batch.column(0).to_pylist()
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                for n, buckets in _buckets(text.as_py()):
                    out[:3, k] += n, len(buckets), gain[buckets].sum()
                out[3, k] = out[2, k] + noise(ids[k])
            yield pa.record_batch([batch.column(0), *map(pa.array, out)],
                                  names=["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition with their place in it, and the partition's own number."""
    from pyspark import TaskContext
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.record_batch([*batch.columns, pa.repeat(pa.scalar(part, pa.int32()), n), pa.array(np.arange(at + 1, at + n + 1))],
                              names=[*batch.schema.names, "part", "place"])
        at += n


def ranked(rows: DataFrame, order: list, name: str = "importance-order") -> DataFrame:
    """``rows`` with ``turn``, their place (from 1) in the whole ``order``; no task sorts more than its range."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int, place bigint"
    placed = persisted(dealt.mapInArrow(_numbered, schema), name)
    sizes = sorted(placed.groupBy("part").agg(F.max("place")).collect())  # a row per partition
    starts = accumulate((size for _, size in sizes), initial=0)
    before = placed.sparkSession.createDataFrame([(r[0], start) for r, start in zip(sizes, starts)], "part int, before bigint")
    return placed.join(F.broadcast(before), "part").select(*rows.columns, (F.col("before") + F.col("place")).alias("turn"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``: ``percent`` of the documents of ``least`` words drawn.

    ``rank`` is null for rows that are not drawn.
    """
    rows = weights(docs, gains(bucket_counts(target), bucket_counts(docs)))
    fits = F.col("n_words") >= least
    out = ranked(rows, [fits.desc(), F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")])
    drawn = out.where(fits).agg(F.expr(f"count(*) * {int(percent)} div 100").alias("drawn"))
    rank = F.when(fits & (F.col("turn") <= F.col("drawn")), F.col("turn"))
    return out.join(F.broadcast(drawn)).select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and ranks of ``documents`` drawn towards ``benchmark``."""
    out = resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
