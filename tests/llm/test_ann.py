import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID, SF_SMALL
from visitlens.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, score string"


def brute(rows, is_query, k):
    """{query: [(vec_id, score)]} over the valid rows."""
    rows = [(i, np.array(v, np.float64)) for i, v in rows]
    out = {}
    for i, v in rows:
        if is_query(i):
            scored = [(-float((v * w).sum() / np.sqrt((v * v).sum()) / np.sqrt((w * w).sum())), j) for j, w in rows if j != i]
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hit = total = 0
    for q, best in want.items():
        near = {round(s, 9) for _, s in best}
        hit += sum(round(s, 9) in near for _, s in got[q])
        total += len(best)
    return hit / total


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 60, "block_rows": 25, "chunk": 3}])
def test_recall_on_embeddings(spark, sizes):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF_SMALL}/embeddings.parquet").to_pylist()]
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    got = grouped(ann.nearest(df, F.col("vec_id") % 10 == 0, 5, **sizes))
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9


def test_registered_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF_MID}/embeddings.parquet").to_pylist()]
    assert recall(grouped(ann.op4_ann(spark, SF_MID)), brute(rows, lambda i: i % 50 == 0, 5)) >= 0.9


def test_ties_and_invalid_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(40)]
    hot = rng.standard_normal(6).astype(np.float32).tolist()
    good += [(100 + i, hot) for i in range(90)] + [(300, [2 * x for x in hot])]
    bad = [(500, None), (501, [0.0] * 6), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] + [1.0] * 5), (504, [float("inf")] + [1.0] * 5),
           (505, [1.0, 2.0]), (506, []), (None, hot)]
    df = spark.createDataFrame([(*r, "x") for r in [*good, *bad, good[0]]], SCHEMA)
    got = grouped(ann.nearest(df.repartition(4), F.col("vec_id") % 50 == 0, 5, cell_rows=20, block_rows=10))
    want = brute(good, lambda i: i % 50 == 0, 5)
    assert got.keys() == want.keys()
    assert [j for j, _ in got[100]] == [101, 102, 103, 104, 105]
    assert [j for j, _ in got[150]] == [100, 101, 102, 103, 104]
    assert recall(got, want) >= 0.9


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], ""), (50, [1.0, 1.0], ""), (3, [0.0, 1.0], "")], SCHEMA)
    got = grouped(ann.nearest(df, F.col("vec_id") % 50 == 0, 5))
    assert [j for j, _ in got[0]] == [50, 3] and [j for j, _ in got[50]] == [0, 3]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert ann.nearest(df.limit(1), F.col("vec_id") % 50 == 0, 5).count() == 0
