import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tests.conftest import SF_SMALL
from visitlens.llm import importance as I
from visitlens.llm import pieces as P

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, text in docs:
        n, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fits = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(fits[: 5 * len(fits) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def made(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "ñandú", "x1", "99", "élan", "zebra", "a", "Ωmega"]
    text = lambda n: rng.choice([" ", ", ", "\n", "_", "\x7f"]).join(rng.choices(words, k=n))
    docs = [(k, text(rng.choice([1, 2, 19, 20, 21, 40, 60]))) for k in range(150)]
    docs += [(500, None), (501, ""), (502, " ... "), (None, text(30)), (7, docs[7][1]), (7, text(25)), (600, "long word " * 30_000)]
    return docs, [text(15) for _ in range(8)] + [None, ""]


def run(spark, docs, target):
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id bigint, text string, rank int, bucket int, n int")
    b = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id bigint, text string")
    out = I.resampled(d.repartition(6), b).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_plain_form(spark, seed):
    docs, target = made(seed)
    assert run(spark, docs, target) == plain(docs, target)


def test_no_target_and_no_documents(spark):
    docs, _ = made(4)
    assert run(spark, docs, []) == plain(docs, [])
    assert run(spark, [], ["a b c"]) == []


def test_ties_go_to_the_smaller_id(spark):
    rows = [(5, 9), (3, 9), (4, 10), (1, 9), (None, 9)] * 40
    df = spark.createDataFrame(rows, "doc_id bigint, score bigint").repartition(7)
    from pyspark.sql import functions as F
    out = sorted((r["turn"], r["score"], r["doc_id"]) for r in I.ranked(df, [F.desc("score"), F.asc("doc_id")]).collect())
    assert [t for t, *_ in out] == list(range(1, 201))
    assert [(-s, d is not None, d or 0) for _, s, d in out] == sorted((-s, d is not None, d or 0) for d, s in rows)


def test_pieces_do_not_cut_words_or_runs():
    text = ("Alpha beta--γάμμα " * 50 + "x" * 500 + " end").encode()
    whole = [w for part in P.pieces(text, I.WORDS) for w in part]
    for size in (1, 7, 64, 300):
        assert [w for part in P.pieces(text, I.WORDS, size) for w in part] == whole
    assert whole == [w.encode() for w in WORD.findall(text.decode().lower())]


def test_features_over_pieces(monkeypatch):
    text = "one two three four, five six seven " * 20
    want = Counter(features(text)[1])
    for size in (1, 5, 17, 1000):
        monkeypatch.setattr(I, "pieces", lambda t, table, size=size: P.pieces(t, table, size))
        got = Counter(b for _, part in I._buckets(text.encode()) for b in part.tolist())
        assert got == want


def test_query_over_the_given_tables(spark):
    from visitlens.llm.common import read
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in read(spark, SF_SMALL, "benchmark").select("text").collect()]
    assert sorted(map(tuple, I.op12_importance_resampling(spark, SF_SMALL).collect()), key=str) == plain(docs, target)
