"""Nearest neighbours by cosine: Gaussian projections in a kd-tree, verified until a chi-square test holds.

Vectors are scaled to length one, where the largest cosine is the least Euclidean distance, and projected
onto ``PROJECTIONS`` Gaussian directions (a 2-stable family). Squared projected distance over squared
distance then follows a chi-square law, so with the k-th best distance ``d`` known, a vector nearer than
``d`` lies beyond projected distance ``r`` with probability at most ``1 - CDF(r^2 / d^2)``: the search of
projected neighbours stops when the CDF reaches ``CONFIDENCE``.

The tree's upper levels split all vectors into cells (fitted on at most ``SAMPLE`` projected vectors; every
vector is indexed); a cell's rows are dealt to blocks that fit one task, and each block builds the lower
levels. A query first searches its own cell, which bounds ``d``, and then only the cells whose box passes the
test. Queries meet a block in chunks, so no group grows with the data. Of equal vectors only the ``k + 1``
least ids can ever be among the k nearest, and only they are indexed: a vector that a third of all rows
share is a handful of rows.

Defined results: vectors that are null, zero or of another length than the commonest, or hold null or
non-finite components, take no part, nor do rows without an id; of repeated ids one row counts (the
least vector); with fewer than k candidates all are returned; an empty table gives no rows. Only ``vec_id``
and ``embedding`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.llm.common import persisted, read

#: Fixed values of the query contract.
K, EVERY = 5, 50
PROJECTIONS, SEED, CONFIDENCE = 16, 20, 0.95
#: Bounded sample for the upper levels, rows of a cell and a block, queries of a chunk, rows of a leaf.
SAMPLE, CELL_ROWS, BLOCK_ROWS, CHUNK, LEAF = 16_384, 4096, 8192, 512, 64
#: Room for rounding in squared distances.
SLACK = 1e-9
#: (query, row) pairs that are compared at once.
PAIRS = 1 << 17


def chi_square_quantile(p: float, m: int = PROJECTIONS) -> float:
    """x with CDF(x) = p for an even number ``m`` of degrees of freedom, by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


def units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


class Splits(NamedTuple):
    """Upper levels of the tree in breadth-first order; ``axis`` -1 ends in the cell ``cell``."""

    axis: np.ndarray
    at: np.ndarray
    cell: np.ndarray

    def cells(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        while True:
            axis = self.axis[node]
            inner = axis >= 0
            if not inner.any():
                return self.cell[node]
            right = p[np.arange(len(p)), np.maximum(axis, 0)] > self.at[node]
            node = np.where(inner, 2 * node + 1 + right, node)


def fit_splits(sample: np.ndarray, cells: int) -> Splits:
    """Median splits of ``sample`` along its widest axis into about ``cells`` cells."""
    depth = max(0, math.ceil(math.log2(max(cells, 1))))
    size = (1 << (depth + 1)) - 1
    axis, at, cell = np.full(size, -1), np.zeros(size), np.zeros(size, np.int64)
    parts = {0: sample}
    n = 0
    for node in range(size):
        part = parts.pop(node, None)
        if part is None:
            continue
        spread = np.ptp(part, axis=0) if len(part) > 1 else np.zeros(1)
        if 2 * node + 2 < size and spread.max() > 0:
            k = int(spread.argmax())
            middle = float(np.median(part[:, k]))
            low = part[:, k] <= middle
            if 0 < low.sum() < len(part):
                axis[node], at[node] = k, middle
                parts[2 * node + 1], parts[2 * node + 2] = part[low], part[~low]
                continue
        cell[node] = n
        n += 1
    return Splits(axis, at, cell)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part, one per id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.where("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    rows = persisted(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("embedding") == (common["dim"] if common else 0))


def _projected(splits: Splits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("embedding"))
            p = units(v) @ directions(v.shape[1]) if len(v) else np.zeros((0, PROJECTIONS))
            yield pa.record_batch([*batch.columns, pa.array(splits.cells(p)), *(pa.array(p[:, i]) for i in range(PROJECTIONS))],
                                  names=[*batch.schema.names, "cell", *_P])

    return run


_P = [f"p{i}" for i in range(PROJECTIONS)]
_P_SCHEMA = ", ".join(f"{c} double" for c in _P)


class Block:
    """The lower levels: leaves of a block's projected vectors, with their boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, p: np.ndarray):
        self.ids, self.vectors, self.p = ids, vectors, p
        self.length = np.sqrt((vectors * vectors).sum(axis=1))
        self.leaves = []
        todo = [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            spread = np.ptp(p[rows], axis=0)
            if len(rows) <= LEAF or spread.max() == 0:
                self.leaves.append(rows)
                continue
            by = rows[np.argsort(p[rows, spread.argmax()], kind="stable")]
            todo += [by[: len(by) // 2], by[len(by) // 2 :]]
        self.size = np.array([len(r) for r in self.leaves])
        self.start, self.rows = np.cumsum(self.size) - self.size, np.concatenate(self.leaves)
        self.low = np.array([p[r].min(axis=0) for r in self.leaves])
        self.high = np.array([p[r].max(axis=0) for r in self.leaves])

    def nearest(self, own: np.ndarray, v: np.ndarray, p: np.ndarray, least: np.ndarray, k: int,
                stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best of every query ``own``; ``least`` are scores that k others are known to reach.

        The queries walk their leaves together, nearest first, one leaf a round: a round verifies the rows of
        all (query, leaf) pairs that still pass the test, and its finds tighten the test for the next round.
        """
        away = np.empty((len(own), len(self.leaves)))
        for leaf in range(len(self.leaves)):
            off = np.maximum(np.maximum(self.low[leaf] - p, p - self.high[leaf]), 0.0)
            away[:, leaf] = (off * off).sum(axis=1)
        order = np.argsort(away, axis=1, kind="stable")
        length = np.sqrt((v * v).sum(axis=1))
        reach = stop * (np.maximum(0.0, 2 - 2 * least) + SLACK)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        going = np.arange(len(own))
        for turn in range(len(self.leaves)):
            going = going[away[going, order[going, turn]] <= reach[going]]
            if not len(going):
                break
            leaf = order[going, turn]
            at = 0
            while at < len(going):
                # a run of pairs of bounded size; a leaf of equal projections may be a run of its own
                stop_at = at + max(1, int(np.searchsorted(np.cumsum(self.size[leaf[at:]]), PAIRS, "right")))
                best = self._verified(best, going[at:stop_at], leaf[at:stop_at], own, v, p, length, reach, k)
                at = stop_at
            query, _, score = best
            last = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else np.zeros(0, np.int64)
            full = last[np.diff(np.append(-1, last)) == k]
            reach[query[full]] = np.minimum(reach[query[full]], stop * (np.maximum(0.0, 2 - 2 * score[full]) + SLACK))
        return best

    def _verified(self, best, query, leaf, own, v, p, length, reach, k):
        """``best`` with the rows of the ``leaf`` of each ``query`` that pass the test, cut to k a query."""
        size = self.size[leaf]
        which = np.repeat(query, size)
        rows = self.rows[np.repeat(self.start[leaf] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        off = self.p[rows] - p[which]
        held = ((off * off).sum(axis=1) <= reach[which]) & (self.ids[rows] != own[which])
        which, rows = which[held], rows[held]
        # Summed row by row: equal vectors have equal scores wherever they lie.
        score = (self.vectors[rows] * v[which]).sum(axis=1) / (self.length[rows] * length[which])
        query, ids, score = (np.concatenate(c) for c in zip(best, (which, self.ids[rows], score)))
        by = np.lexsort((ids, -score, query))
        first = np.searchsorted(query[by], query[by], "left")
        by = by[np.arange(len(by)) - first < k]
        return query[by], ids[by], score[by]


def _search(k: int, stop: float):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        query, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(rows) and len(queries):
            rows, queries = rows.combine_chunks(), queries.combine_chunks()
            part = lambda t: (t["vec_id"].to_numpy(), _matrix(t["embedding"].chunk(0)), np.column_stack([t[c].to_numpy() for c in _P]))
            own, v, p = part(queries)
            query, ids, scores = Block(*part(rows)).nearest(own, v, p, queries["least"].to_numpy(), k, stop)
            query = own[query]
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query, k: int = K, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS,
            block_rows: int = BLOCK_ROWS, chunk: int = CHUNK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of the rows for which the condition ``is_query`` holds."""
    rows = valid(vectors)
    # Equal vectors tie for every query, so all but their least ids can be left out.
    twin = Window.partitionBy("embedding").orderBy("vec_id")
    kept = persisted(rows.withColumn("twin", F.row_number().over(twin)).where(F.col("twin") <= k + 1).drop("twin"), "kept")
    n = kept.count()
    flat = Splits(np.array([-1]), np.zeros(1), np.zeros(1, np.int64))
    schema = f"vec_id bigint, embedding {dict(kept.dtypes)['embedding']}, cell bigint, {_P_SCHEMA}"
    # Projected first: a row of the sample is eight numbers however long the vectors are.
    some = kept.mapInArrow(_projected(flat), schema).select("vec_id", *_P).orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow()
    splits = fit_splits(np.column_stack([some[c].to_numpy() for c in _P]), min(-(-n // cell_rows), SAMPLE // 8))
    placed = persisted(kept.mapInArrow(_projected(splits), schema), "placed")
    queries = persisted(rows.where(is_query).mapInArrow(_projected(splits), schema), "queries")
    # One row per cell, SAMPLE / 8 at most: small enough to broadcast.
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *(F.min(c).alias(f"low_{c}") for c in _P), *(F.max(c).alias(f"high_{c}") for c in _P))
    boxes = persisted(boxes.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")), "boxes")
    placed = placed.join(F.broadcast(boxes.select("cell", "blocks")), "cell")
    placed = placed.withColumn("block", F.expr("CAST(pmod(xxhash64(vec_id), blocks) AS INT)")).drop("blocks")
    stop = chi_square_quantile(confidence)
    home = _met(placed, queries.withColumn("least", F.lit(-1.0)), boxes, stop, k, chunk, at_home=True)
    first = _best(home, k)
    bound = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    asked = queries.join(bound, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")
    asked = asked.withColumn("least", F.coalesce("least", F.lit(-1.0)))
    away = _met(placed, asked, boxes, stop, k, chunk, at_home=False)
    return _best(first.drop("rank").unionByName(away), k).select("query_id", "rank", "vec_id", "score")


def _met(placed: DataFrame, queries: DataFrame, boxes: DataFrame, stop: float, k: int, chunk: int, at_home: bool) -> DataFrame:
    """What the queries find in their own cell, or in the others that pass the test."""
    side = boxes.toArrow()
    cell, blocks = side["cell"].to_numpy(), side["blocks"].to_numpy()
    low, high = (np.array([side[f"{end}_{c}"].to_numpy() for c in _P]).T.reshape(-1, PROJECTIONS) for end in ("low", "high"))
    kind = dict(placed.dtypes)["embedding"]
    row_of = {int(c): i for i, c in enumerate(cell)}

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.column_stack([batch.column(c).to_numpy() for c in _P])
            own = batch.column("cell").to_numpy()
            reach = stop * (np.maximum(0.0, 2 - 2 * batch.column("least").to_numpy()) + SLACK)
            which, where, block = [], [], []
            for i in range(len(p)):
                if at_home:
                    go = [row_of[int(own[i])]] if int(own[i]) in row_of else []
                else:
                    off = np.maximum(np.maximum(low - p[i], p[i] - high), 0.0)
                    go = np.flatnonzero(((off * off).sum(axis=1) <= reach[i]) & (cell != own[i])).tolist()
                for g in go:
                    which += [i] * int(blocks[g])
                    where += [int(cell[g])] * int(blocks[g])
                    block += range(int(blocks[g]))
            out = batch.drop_columns(["cell"]).take(pa.array(which, pa.int64()))
            yield pa.record_batch([*out.columns, pa.array(where, pa.int64()), pa.array(block, pa.int32())], names=[*out.schema.names, "cell", "block"])

    asked = queries.mapInArrow(visits, f"vec_id bigint, embedding {kind}, {_P_SCHEMA}, least double, cell bigint, block int")
    asked = persisted(asked, "asked")
    per = asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    per = persisted(per, "chunks")
    dealt = placed.join(per, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    asked = asked.join(per, ["cell", "block"]).withColumn("part", F.expr("CAST(pmod(xxhash64(vec_id, 'part'), chunks) AS INT)")).drop("chunks")
    keys = ["cell", "block", "part"]
    return persisted(dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k, stop), "query_id bigint, vec_id bigint, score double"), "found")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
