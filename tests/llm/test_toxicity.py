import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from visitlens.llm import toxicity as X


def grams_of(word):
    spelled = b"    " + word + b" "
    return [spelled[i - 4 : i + 1] for i in range(4, len(spelled))]


class Plain:
    """The two models with dictionaries, byte by byte."""

    def __init__(self, toxic, ordinary):
        self.n = [Counter(g for w in ws for g in grams_of(w)) for ws in (toxic, ordinary)]
        types = set(self.n[0]) | set(self.n[1])
        self.after = {}  # continuation counts by length
        for length in (4, 3, 2, 1):
            self.after[length] = Counter(g[1:] for g in types)
            types = set(self.after[length])

    def shared(self, g):
        if not g:
            return 1 / 256
        own = {k: v for k, v in self.after[len(g)].items() if k[:-1] == g[:-1]}
        if g not in own:
            return None
        total = sum(own.values())
        return (own[g] - 0.75 + 0.75 * len(own) * self.shared(g[1:])) / total

    def ratio(self, word):
        out = 0.0
        for g in grams_of(word):
            seen = g in self.n[0] or g in self.n[1]
            logs = []
            for n in self.n:
                own = {k: v for k, v in n.items() if k[:-1] == g[:-1]}
                total = sum(own.values())
                mass = 0.75 * len(own) / total if total else 1.0
                p = (max(own.get(g, 0) - 0.75, 0) / total if total else 0.0) + mass * (self.shared(g[1:]) if seen else 1.0)
                logs.append(math.log(p))
            out += logs[0] - logs[1]
        return out


def model_of(spark, rows):
    df = spark.createDataFrame([(y, t, 0) for t, y in rows], "toxic int, text string, gram int")
    return X.fit(X.gram_counts(df.repartition(3)))


@pytest.mark.parametrize("seed", range(3))
def test_ratios_equal_a_plain_model(spark, seed):
    rng = random.Random(seed)
    syllables = ["an", "be", "co", "dé", "e", "fu"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = [(" ".join(word() for _ in range(rng.randint(0, 12))) + (" Grumf" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(40)]
    rows += [("", 1), ("...", 0), (None, 0)]
    model = model_of(spark, rows)
    split = lambda t: [w for part in X.pieces((t or "").encode(), X.WORDS) for w in part]
    plain = Plain([w for t, y in rows if y for w in split(t)], [w for t, y in rows if not y for w in split(t)])
    tried = [b"grumf", b"grumfs", b"an", b"zzz", "dédé".encode(), b"bebebe", b"f", b"grubean"]
    assert X.word_ratios(model, tried) == pytest.approx([plain.ratio(w) for w in tried], abs=1e-4)


def corpus(seed, n=1200):
    rng = random.Random(seed)
    syllables = ["an", "be", "co", "dé", "el", "fu", "ga", "hi"]
    suffixes = ["a", "on", "chen", "ique", "s", "ado"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([5, 40, 400]))]
        toxic = int(rng.random() < 0.15)
        for at in rng.sample(range(len(words)), 3 * toxic):
            words[at] = "vrikz" + rng.choice(suffixes)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_rows_and_long_texts(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "x", 0.5, 1.5) for i, t, _ in rows], "doc_id bigint, text string, lang string, score double, ratio double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1), (10**6, 1), (5, rows[5][2])], "doc_id bigint, toxic int")
    model = X.learned(docs, labels)
    extra = [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "vrikzon"), (10**7 + 3, "an be co " * 200_000), (None, "an"),
             (10**7 + 4, "an be co " * 200_000 + "vrikzado vrikzs " + "hi " * 100_000), (10**7 + 5, "x" * 300_000)]
    more = docs.unionByName(spark.createDataFrame([(i, t, None, 0.0, 0.0) for i, t in extra], docs.schema))
    got = X.score(more, model)
    assert got.columns == ["doc_id", "ratio", "score"]
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    assert len(score) == len(rows) + len(extra) and all(0 <= s <= 1 for s in score.values())
    assert all((score[i] >= 0.5) == bool(y) for i, _, y in rows)
    assert score[10**7 + 2] >= 0.5 and score[10**7 + 4] >= 0.5
    assert max(score[i] for i in (10**7, 10**7 + 1, 10**7 + 3, 10**7 + 5, None)) < 0.5


def test_held_out_labels_are_not_learned(spark):
    rows = corpus(2, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    import zlib
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a = X.learned(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    b = X.learned(docs, spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id bigint, toxic int"))
    assert a.curve == b.curve and np.array_equal(a.ratios, b.ratios) and np.array_equal(a.grams, b.grams)


def test_the_model_is_bounded(spark):
    counts = spark.createDataFrame([(g, g % 3, 1 + g % 50) for g in range(3000)], "gram bigint, toxic_n bigint, ordinary_n bigint")
    kept = X.most_frequent(counts, 500)
    least = min(r["toxic_n"] + r["ordinary_n"] for r in kept.collect())
    assert 0 < kept.count() <= 500 and kept.count() == counts.where(f"toxic_n + ordinary_n >= {least}").count()


@pytest.mark.parametrize("rows", [[], [("an be", 0)] * 4, [("an be", 1)] * 4])
def test_no_or_one_class(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(99, "an zz"), (98, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    model = X.learned(docs, labels)
    assert model.curve == X.PLAIN_CURVE
    assert all(0 <= r["score"] <= 1 for r in X.score(docs, model).collect())
    assert X.score(docs.limit(0), model).count() == 0


def test_a_small_memory_of_words(monkeypatch, spark):
    model = model_of(spark, [(t, y) for _, t, y in corpus(3, 60)])
    texts = [t.encode().split() for _, t, _ in corpus(4, 50)]
    want = [r.tolist() for r in X._Scorer(model).ratios(texts)]
    monkeypatch.setattr(X, "REMEMBERED", 20)
    scorer = X._Scorer(model)
    assert [scorer.ratios([t])[0].tolist() for t in texts] == want


def test_query_columns(spark):
    out = X.op13_toxicity(spark, SF_SMALL)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in out.collect())


@pytest.mark.parametrize("size", [0, 150])
def test_a_model_beyond_its_size_loses_no_gram(spark, size):
    """Every n-gram counts, also the rare ones that don't travel."""
    rows = corpus(5, 150)
    counts = X.gram_counts(spark.createDataFrame([(y, t) for _, t, y in rows], "toxic int, text string")).localCheckpoint()
    small, wide = X.fit(counts), X.fit(counts, size)
    assert isinstance(wide, X.Wide) and len(wide.frequent.grams) <= size < len(small.grams) == wide.ratios.count()
    texts = [t for _, t, _ in corpus(6, 40)] + [None, "", "...", "an", "an an", "zzzq", "vrikzon be", "hi " * 400_000 + "vrikzado vrikzado", "hi " * 400_000 + "vrikzado"]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)] + [(3, texts[3], 0.5), (None, texts[0], 0.5)], "doc_id bigint, text string, ratio double")
    of = lambda m: sorted((str(r["doc_id"]), round(r["ratio"], 3), round(r["score"], 4)) for r in X.score(docs.repartition(4), m).collect())
    curve = (0.7, -1.5)
    got, want = of(wide._replace(curve=curve)), of(small._replace(curve=curve))
    assert len(got) == len(want) == len(texts) + 2
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=2e-3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    assert X.learned(docs, labels, size).curve == pytest.approx(X.learned(docs, labels).curve, rel=1e-3)
