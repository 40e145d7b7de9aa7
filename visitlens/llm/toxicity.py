"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary words, compared by log-likelihood.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased, spelled as bytes between word ends.
Each class models a byte by the up to four before it in its word, with absolute discounting; the discounted mass
goes to one backoff distribution that both classes share, made of continuation counts over all labelled texts.
So a form seen once on one side says little, while a stem that one class alone uses tells them apart in every
compound. A word's ratio is the sum of its bytes' log-ratios; a text is compared on the ``TELLING`` words that
speak most for the toxic model, its log-likelihoods being normalised to the length of that passage, so that long
texts are not diluted. A logistic curve fitted on a further fold turns the ratio into a score.

All labelled rows outside the held-out and the calibration fold are counted, in the map tasks first. A model of
``SIZE`` n-grams at most travels (25 MB) and texts are scored where they lie. A larger one stays a pair of tables
with every n-gram in it (``Wide``): its most frequent n-grams travel with their exact ratios, words made of these
alone are settled in the map tasks, and the ratios of all other words come from joins with the tables.

Defined results: null, empty and word-less texts have ratio 0; a text of one word is compared on that word;
labels that are null, or whose document is missing, are not learned from; repeated (doc_id, label) pairs count
once per row of the document; with one class only all ratios are 0 or follow the backoff, and the curve is
``PLAIN_CURVE``; a null ``doc_id`` is held out like the text ''. Only ``doc_id``, ``text`` and the label are
read, so other columns cannot clash; whole texts are read in pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.llm.common import persisted, read, small_batches
from visitlens.llm.pieces import pieces, translation

#: Bytes of an n-gram, discount, n-grams of the model, words of the compared passage.
ORDER, DISCOUNT, SIZE, TELLING = 5, 0.75, 1 << 20, 2
#: Labelled rows that the curve is fitted on, those with the smallest hashes; the curve where a class is missing.
CALIBRATION, PLAIN_CURVE = 4000, (1.0, -8.0)
#: Fixed values of the query contract; the last fold is the curve's.
FOLDS, THRESHOLD = 5, 0.5
#: Distinct words that a map task holds, words whose ratio a worker remembers, bytes of text scored together.
HELD, REMEMBERED, TOGETHER = 400_000, 400_000, 1 << 21

WORDS = translation("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
START = b" " * (ORDER - 1)


class Model(NamedTuple):
    grams: np.ndarray  #: sorted n-grams, the last byte lowest
    ratios: np.ndarray
    contexts: np.ndarray  #: sorted n-grams without their last byte
    unseen: np.ndarray  #: ratio of a byte that the context was never followed by
    curve: tuple[float, float]


class Wide(NamedTuple):
    """A model of more than ``SIZE`` n-grams."""

    ratios: DataFrame  #: ``gram, ratio``
    unseen: DataFrame  #: ``context, unseen``
    frequent: Model  #: the most frequent n-grams with their ratios, no contexts
    curve: tuple[float, float]


def _spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of every byte and word end, its word) of ``words``."""
    data = np.frombuffer(START + (b" " + START).join(words) + b" ", np.uint8)
    keys = np.zeros(len(data), np.uint64)
    for back in range(ORDER):
        keys[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    own = data != 32
    own[1:] |= own[:-1].copy()
    own_data = data[own]
    ends = own_data == 32
    return keys[own], np.cumsum(ends) - ends


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``toxic, text`` rows to ``toxic, gram, n``."""
    held: dict[int, Counter[bytes]] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            for words in pieces(text.as_py() or b"", WORDS):
                held[toxic].update(words)
                if len(held[toxic]) >= HELD:
                    yield from _passed(toxic, held[toxic])
                    held[toxic].clear()
    for toxic, words in held.items():
        yield from _passed(toxic, words)


def _passed(toxic: int, words: Counter[bytes]) -> Iterator[pa.RecordBatch]:
    if words:
        keys, word = _spelled(list(words))
        grams, at = np.unique(keys, return_inverse=True)
        n = np.zeros(len(grams), np.int64)
        np.add.at(n, at, np.fromiter(words.values(), np.int64, len(words))[word])
        yield pa.record_batch({"toxic": pa.repeat(pa.scalar(toxic, pa.int32()), len(grams)),
                               "gram": pa.array(grams.astype(np.int64)), "n": pa.array(n)})


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``gram, toxic_n, ordinary_n`` over all rows of ``labelled`` (``toxic`` 0/1, ``text``)."""
    parts = small_batches(labelled).select("toxic", "text").mapInArrow(_counted, "toxic int, gram bigint, n bigint")
    of = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0))
    return parts.groupBy("gram").agg(of(1).alias("toxic_n"), of(0).alias("ordinary_n"))


def most_frequent(counts: DataFrame, size: int = SIZE) -> DataFrame:
    """The n-grams whose count reaches a bound that at most ``size`` of them reach, in steps of a per cent."""
    step = F.floor(F.log2(F.col("toxic_n") + F.col("ordinary_n")) * 64).cast("int")
    least, held = 64 * 64, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 4,096 rows at most
        held += r["count"]
        if held > size:
            break
        least = r["step"]
    return counts.where(step >= least)


def _shared(grams: np.ndarray) -> np.ndarray:
    """Backoff probability of the last byte of each n-gram after all but its first, from continuation counts."""
    levels, types = [], grams
    for length in range(ORDER - 1, 0, -1):
        mask = np.uint64((1 << 8 * length) - 1)
        types, followers = np.unique(types & mask, return_counts=True)
        levels.append((types, followers, mask))
    chance, lower, mask = np.full(1, 1 / 256), np.zeros(1, np.uint64), np.uint64(0)
    for types, followers, own_mask in reversed(levels):
        at = np.unique(types >> np.uint64(8), return_inverse=True)[1]
        total, kinds = np.bincount(at, followers)[at], np.bincount(at)[at]
        backoff = chance[np.searchsorted(lower, types & mask)]
        chance, lower, mask = (followers - DISCOUNT + DISCOUNT * kinds * backoff) / total, types, own_mask
    return chance[np.searchsorted(lower, grams & mask)]


def _ratios(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    contexts, at = np.unique(grams >> np.uint64(8), return_inverse=True)
    shared = _shared(grams)
    chances, masses = [], []
    for n in (toxic, ordinary):
        total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, n > 0, len(contexts))
        met = total > 0
        mass = np.where(met, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.where(met[at], np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[at], 0.0)
        chances.append(own + mass[at] * shared)
        masses.append(mass)
    ratio = np.log(chances[0] / chances[1]).astype(np.float32)
    return Model(grams, ratio, contexts, np.log(masses[0] / masses[1]).astype(np.float32), PLAIN_CURVE)


def _chances(counts: DataFrame) -> DataFrame:
    """``_shared`` by joins: ``t`` (all bytes of an n-gram but its first) with its backoff ``chance``."""
    levels, types = [], counts.select(F.col("gram").alias("t"))
    for length in range(ORDER - 1, 0, -1):
        types = types.groupBy(F.col("t").bitwiseAND(F.lit((1 << 8 * length) - 1)).alias("t")).agg(F.count("*").alias("f"))
        types = persisted(types, f"toxicity-types-{length}")
        levels.append(types)
    lower = None
    for length, types in enumerate(reversed(levels), 1):
        after = types.groupBy(F.shiftright("t", 8).alias("c")).agg(F.sum("f").alias("total"), F.count("*").alias("kinds"))
        rows = types.join(after, F.shiftright("t", 8) == F.col("c"))
        if lower is None:
            rows = rows.withColumn("backoff", F.lit(1 / 256))
        else:
            rows = rows.join(lower, F.col("t").bitwiseAND(F.lit((1 << 8 * (length - 1)) - 1)) == F.col("low"))
        chance = (F.col("f") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("backoff")) / F.col("total")
        lower = persisted(rows.select(F.col("t").alias("low"), chance.alias("backoff")), f"toxicity-chances-{length}")
    return lower.select(F.col("low").alias("t"), F.col("backoff").alias("chance"))


def wide_model(counts: DataFrame, size: int) -> Wide:
    """The model of all ``counts`` as tables, ``size`` n-grams of it at most for the tasks."""
    classes = ("toxic", "ordinary")
    per = counts.groupBy(F.shiftright("gram", 8).alias("context")).agg(
        *[F.sum(f"{c}_n").alias(f"{c}_total") for c in classes], *[F.count_if(F.col(f"{c}_n") > 0).alias(f"{c}_kinds") for c in classes])
    for c in classes:
        met = F.col(f"{c}_total") > 0
        per = per.withColumn(f"{c}_mass", F.when(met, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0))
    per = persisted(per.withColumn("unseen", F.ln(F.col("toxic_mass") / F.col("ordinary_mass"))), "toxicity-contexts")
    rows = counts.select("gram", *[f"{c}_n" for c in classes]).join(per, F.shiftright("gram", 8) == F.col("context"))
    rows = rows.join(_chances(counts), F.col("gram").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1)) == F.col("t"))
    chance = {c: F.when(F.col(f"{c}_total") > 0, F.greatest(F.col(f"{c}_n") - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_total")).otherwise(0.0)
              + F.col(f"{c}_mass") * F.col("chance") for c in classes}
    rows = persisted(rows.select("gram", "toxic_n", "ordinary_n", F.ln(chance["toxic"] / chance["ordinary"]).alias("ratio")), "toxicity-ratios")
    top = most_frequent(rows, size).select("gram", "ratio").toPandas().sort_values("gram")
    none = np.zeros(0)
    frequent = Model(top["gram"].to_numpy(np.uint64), top["ratio"].to_numpy(float), none.astype(np.uint64), none, PLAIN_CURVE)
    return Wide(rows.select("gram", "ratio"), per.select("context", "unseen"), frequent, PLAIN_CURVE)


def _settled(model: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log-ratio of each word, and whether all its n-grams are in ``model``."""
    if not words or not len(model.grams):
        return np.zeros(len(words)), np.zeros(len(words), bool)
    keys, word = _spelled(words)
    at = np.searchsorted(model.grams, keys).clip(max=len(model.grams) - 1)
    return np.bincount(word, model.ratios[at], len(words)), np.bincount(word, model.grams[at] != keys, len(words)) == 0


def _joined_ratios(words: DataFrame, model: Wide) -> DataFrame:
    """``word, ratio`` of distinct ``word`` (binary) by joins with the tables of ``model``."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            if own:
                keys, word = _spelled(own)
                yield pa.record_batch([batch.column(0).take(pa.array(word)), pa.array(keys.astype(np.int64))], names=["word", "own"])

    rows = words.mapInArrow(spelled, "word binary, own bigint")
    rows = rows.join(model.ratios, F.col("own") == F.col("gram"), "left")
    rows = rows.join(model.unseen, F.shiftright("own", 8) == F.col("context"), "left")
    return rows.groupBy("word").agg(F.sum(F.coalesce("ratio", "unseen", F.lit(0.0))).alias("ratio"))


def _wide_ratios(texts: DataFrame, model: Wide) -> DataFrame:
    """``key, ratio`` of the distinct texts with words, from ``key, text``: the mean of the ``TELLING`` leading words."""
    frequent = texts.sparkSession.sparkContext.broadcast(model.frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, others, times = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                top, rest = np.zeros(0), Counter()
                for words in pieces(text.as_py() or b"", WORDS):
                    met = Counter(words)
                    own = list(met)
                    ratio, known = _settled(frequent.value, own)
                    n = np.minimum(np.fromiter(met.values(), np.int64, len(own)), TELLING)
                    top = np.sort(np.concatenate([top, np.repeat(ratio[known], n[known])]))[-TELLING:]
                    rest.update({own[k]: int(n[k]) for k in np.flatnonzero(~known)})
                best.append(top.tolist())
                others.append(list(rest))
                times.append([min(k, TELLING) for k in rest.values()])
            yield pa.record_batch([batch.column("key"), pa.array(best, pa.list_(pa.float64())), pa.array(others, pa.list_(pa.binary())),
                                   pa.array(times, pa.list_(pa.int32()))], names=["key", "best", "words", "times"])

    rows = texts.mapInArrow(run, "key binary, best array<double>, words array<binary>, times array<int>")
    rows = persisted(persisted(rows, "toxicity-words").dropDuplicates(["key"]), "toxicity-texts")
    rest = rows.select("key", F.explode(F.arrays_zip("words", "times")).alias("w")).select("key", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    known = persisted(_joined_ratios(rest.select("word").distinct(), model), "toxicity-word-ratios")
    joined = rest.join(known, "word").select("key", F.explode(F.array_repeat("ratio", F.col("times"))).alias("ratio"))
    every = rows.select("key", F.explode("best").alias("ratio")).unionByName(joined)
    leading = every.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ratio")))).where(F.col("place") <= TELLING)
    return leading.groupBy("key").agg(F.avg("ratio").alias("ratio"))


def _wide_score(docs: DataFrame, model: Wide, keep: tuple[str, ...]) -> DataFrame:
    key = F.unhex(F.sha2("text", 256))
    ratios = persisted(_wide_ratios(small_batches(docs).select(key.alias("key"), "text"), model), "toxicity-text-ratios")
    own = docs.select(F.struct(*keep).alias("row"), key.alias("own")).join(ratios, F.col("own") == F.col("key"), "left")
    ratio = F.coalesce("ratio", F.lit(0.0))
    slope, offset = model.curve
    logit = F.greatest(F.least(ratio * slope + offset, F.lit(30.0)), F.lit(-30.0))
    return own.select("row.*", ratio.alias("ratio"), (1 / (1 + F.exp(-logit))).alias("score"))


def word_ratios(model: Model, words: list[bytes]) -> np.ndarray:
    """Log-ratio of each word."""
    if not words or not len(model.grams):
        return np.zeros(len(words))
    keys, word = _spelled(words)
    at = np.searchsorted(model.grams, keys).clip(max=len(model.grams) - 1)
    context = keys >> np.uint64(8)
    c = np.searchsorted(model.contexts, context).clip(max=len(model.contexts) - 1)
    unseen = np.where(model.contexts[c] == context, model.unseen[c], 0.0)
    return np.bincount(word, np.where(model.grams[at] == keys, model.ratios[at], unseen), len(words))


class _Scorer:
    """Ratios of texts, remembering those of words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def ratios(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The ratios of the ``TELLING`` leading words of each list, largest last."""
        new = list(set().union(*texts).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            for word in list(islice(self.known, len(self.known) // 2)):
                del self.known[word]
            new = list(set().union(*texts).difference(self.known))
        self.known.update(zip(new, word_ratios(self.model, new).tolist()))
        out = []
        for words in texts:
            ratio = np.fromiter(map(self.known.__getitem__, words), float, len(words))
            out.append(np.sort(np.partition(ratio, -TELLING)[-TELLING:] if len(ratio) > TELLING else ratio))
        return out


def score(docs: DataFrame, model: Model | Wide, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ratio`` and ``score`` of every document."""
    if isinstance(model, Wide):
        return _wide_score(docs, model, keep)
    rows = small_batches(docs).select(*keep, "text")
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("ratio", T.DoubleType()), T.StructField("score", T.DoubleType())])
    slope, offset = model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            best: list[np.ndarray] = [np.zeros(0)] * batch.num_rows
            waiting, owners, size = [], [], 0

            def pass_on():
                for k, top in zip(owners, scorer.ratios(waiting)):
                    best[k] = np.sort(np.concatenate([best[k], top]))[-TELLING:]
                waiting.clear()
                owners.clear()

            for k, text in enumerate(batch.column("text").cast(pa.binary())):
                for words in pieces(text.as_py() or b"", WORDS):
                    waiting.append(words)
                    owners.append(k)
                    size += sum(map(len, words))
                    if size >= TOGETHER:
                        pass_on()
                        size = 0
            pass_on()
            ratio = np.array([b.mean() if len(b) else 0.0 for b in best])
            own = 1 / (1 + np.exp(-np.clip(slope * ratio + offset, -30, 30)))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(ratio, pa.float64()), pa.array(own, pa.float64())],
                                  names=[*keep, "ratio", "score"])

    return rows.mapInArrow(run, schema)


def fitted_curve(ratio: np.ndarray, toxic: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of a logistic curve by Newton steps, with a small penalty on the slope."""
    if not 0 < toxic.sum() < len(toxic):
        return PLAIN_CURVE
    x = np.stack([ratio / 10, np.ones(len(ratio))], 1)
    penalty = np.diag([1e-5 * len(ratio), 1e-9])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - toxic) + penalty @ w
        bend = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return max(float(w[0]), 0.0) / 10, float(w[1])


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds


def fit(counts: DataFrame, size: int = SIZE) -> Model | Wide:
    """The model of ``gram_counts`` with every n-gram, without a curve of its own; as tables beyond ``size`` n-grams."""
    counts = persisted(counts, "toxicity-grams")
    if counts.count() > size:
        return wide_model(counts, size)
    rows = counts.toPandas().sort_values("gram")  # ``size`` rows at most
    return _ratios(rows["gram"].to_numpy(np.uint64), rows["toxic_n"].to_numpy(float), rows["ordinary_n"].to_numpy(float))


def learned(docs: DataFrame, labels: DataFrame, size: int = SIZE) -> Model | Wide:
    """The model of the labels that are not held out: one fold for the curve, the others for the counts."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    last = fold(F.col("doc_id")) == FOLDS - 1
    texts = docs.select("doc_id", "text")
    # one plan at every size: labels grow with the documents, so the join deals texts by id also where it need not
    model = fit(gram_counts(texts.join(known.where(~last).hint("merge"), "doc_id")), size)
    chosen = known.where(last).orderBy(F.xxhash64("doc_id", "toxic"), "doc_id", "toxic").limit(CALIBRATION)
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = score(sample, model, ("toxic",)).toPandas()  # CALIBRATION rows at most
    return model._replace(curve=fitted_curve(rows["ratio"].to_numpy(float), rows["toxic"].to_numpy(float)))


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, learned(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))
