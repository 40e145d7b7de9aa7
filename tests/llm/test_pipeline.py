import collections
import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_ngram_join import brute
from visitlens.llm import bpe, common, mixing, ngram_join, quality_classifier, quality_rules

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows on its own input."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs.collect()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, spark.createDataFrame(out[-1], docs.schema), SF_SMALL).collect()
        out.append(rows)
        if n < 4:
            assert rows and list(rows[0].asDict()) == docs.columns
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "mixing sources to target weights",
                                                      "BPE encoding and decoding"]


def runs_of(text):
    return re.findall(r"(?:[^\x00-\x7f]|[0-9A-Za-z])+|(?:(?![0-9A-Za-z\x20\x09-\x0D])[\x00-\x7f])+", text or "")


WORD64 = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WORD64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WORD64
    return x ^ (x >> 31)


def plain_score(model, text):
    """The logistic of the dot product, token by token."""
    h = [mixed(sum((c + 1) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, c in enumerate(w.encode())) & WORD64) for w in runs_of(text)]
    pairs = [int(quality_classifier.SAME) if a == b else mixed((3 * a + b) & WORD64) for a, b in zip(h, h[1:], strict=False)]
    places = [x & ((1 << model.bits) - 1) for x in [*h, *pairs]]
    dot = sum(float(model.weights[p]) for p in places) * quality_classifier.SCALE / max(len(places), 1)
    return 1 / (1 + math.exp(-(dot + float(model.weights[-1]))))


def test_classifier_stage(spark, stages):
    docs = spark.createDataFrame(stages[0])
    model = quality_classifier.learned(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    kept = {r["doc_id"] for r in stages[1]}
    assert kept == {d for d, s in scores.items() if s >= 0.3}
    for r in stages[0][:60]:
        assert abs(scores[r["doc_id"]] - plain_score(model, r["text"])) < 1e-6


def table(rows):
    import pandas as pd
    return pd.DataFrame([r.asDict() for r in rows])


def test_rules_stage(stages):
    con = duckdb.connect()
    con.register("docs", table(stages[1]))
    want = con.execute(f"WITH {quality_rules._RULES_CTES.format(docs='docs')} SELECT doc_id FROM judged WHERE NOT base_failed AND NOT rejected").fetchall()
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(w[0] for w in want)


def test_near_duplicate_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2]]
    want = sorted(int(d) for d, _, c, _ in brute(rows) if d == c)
    assert sorted(r["doc_id"] for r in stages[3]) == want and len(want) < len(rows)


def test_mixing_stage(stages):
    con = duckdb.connect()
    con.register("docs", table(stages[3]))
    want = dict(con.execute(f"WITH {mixing._MIX_CTES.format(docs='docs')} SELECT doc_id, copies FROM mixed WHERE copies > 0").fetchall())
    assert collections.Counter(r["doc_id"] for r in stages[4]) == want


def test_token_stage(stages):
    t = Tokenizer.from_file(bpe.default_path())
    rows = {r["doc_id"]: r["text"] for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        ids = t.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_equals_stages(spark, stages):
    got = collections.Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF_SMALL).collect())
    assert got == collections.Counter((r["doc_id"], r["ids_sha256"]) for r in stages[5])


ODD = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "w " * 60 + "end", "en", "a", 1), (3, "one two three four five six", "en", "b", 1),
       (3, "one two three four five six", "en", "b", 1), (3, "ONE two three four five six", "en", "b", 1), (4, " \n\t", "x", "b", 2), (5, "long " * 30_000, "en", None, 3)]


def test_odd_rows_pass_every_stage(spark):
    df = spark.createDataFrame([(*r, "clash", 7) for r in ODD], COLUMNS + ", row string, score bigint")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF_SMALL)
        empty = stage(spark, df.limit(0), SF_SMALL)
        assert empty.count() == 0 and out.count() >= 0, name
        if stage is not corpus_pipeline.tokenise:
            assert out.columns == df.columns
    kept = ngram_join.representatives(df).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "4", "5", "None"]


def test_labels_absent(spark):
    docs = spark.createDataFrame(ODD, COLUMNS)
    model = quality_classifier.learned(docs, spark.createDataFrame([(1, None)], "doc_id bigint, quality int"))
    assert {r["score"] for r in quality_classifier.score(docs, model).collect()} == {0.5}


def test_near_duplicate_stage_keeps_no_shuffle_files(spark, monkeypatch):
    """Shuffles of the steps before a stage's result, together several times the input, end with the tables they make."""
    written = {}
    write = common.persisted
    monkeypatch.setattr(common, "persisted", lambda df, name: (written.setdefault(name, set()).add(spark.conf.get(common.CLEANUP_KEY, None)), write(df, name))[1])
    docs = spark.createDataFrame(ODD, COLUMNS)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL).count() == 6
    assert {"candidates", "links", "stars", "tightened", "products", "chosen"} <= set(written)
    assert set.union(*written.values()) == {"true"}
