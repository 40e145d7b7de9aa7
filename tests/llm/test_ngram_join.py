import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF_SMALL
from visitlens.llm import ngram_join as N
from visitlens.llm.common import CLEANUP_KEY, released
from visitlens.llm.components import components, forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [set() for _ in rows]
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        near = {j for g in s for j in by[g] if j != i}
        for j in near:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                links[i].add(j)
    root = list(range(len(rows)))
    todo = True
    while todo:
        todo = False
        for i in range(len(rows)):
            m = min([root[i], *(root[j] for j in links[i])])
            todo, root[i] = todo or m < root[i], m
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return sorted((str(d), len(sets[i]), str(least.get(root[i])), len(links[i])) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in df.collect())


def family(rng, base, n, drift):
    """Copies that differ in a few words, each made from some earlier one."""
    out = [base]
    for _ in range(n):
        w = list(rng.choice(out))
        for _ in range(rng.randrange(1, drift)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(w)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \n", "one", "One", "two words", "a b c d", "a b c d e", "a b c d e", "A B  C\td e"]
    for size, n, drift in ((100, 60, 4), (40, 30, 3), (300, 25, 12), (6, 10, 2)):
        texts += [" ".join(w) for w in family(rng, [rng.choice(vocabulary) for _ in range(size)], n, drift)]
    texts += [" ".join([rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))] + passage) for _ in range(40)]
    texts += [" ".join(passage)] * 15 + [" ".join(passage[:55] + ["tail"])] * 3
    rng.shuffle(texts)
    out = [(i * 3, t) for i, t in enumerate(texts)]
    return [*out, (None, "a b c d e"), (None, "alone here"), (0, out[0][1]), (5, "q " * 3000), (9, "other text")]


@pytest.mark.parametrize("classes,size", [(256, 200_000), (7, 1500)])
def test_equals_brute_force(spark, rows, classes, size):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("doc_id", "doc_id").selectExpr("*", "1 AS node", "2 AS n")
    assert result(N.similar(df.repartition(5), classes, size)) == brute(rows)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF_SMALL}/documents.parquet").to_pylist()]
    assert result(N.op8_ngram_join(spark, SF_SMALL)) == brute(rows)


def test_empty(spark):
    assert N.similar(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_sets_of_words():
    texts = ["", None, "a", "A b c d e f", "a  b c d\ne F " + "é ü x " * 400]
    for row, s in N.shingle_sets(pa.array(texts)):
        assert len(s) == len(shingles(texts[row]))
    many = [" ".join(random.Random(k).choices("abcdefg", k=k % 23)) for k in range(500)]
    sets = dict(N.shingle_sets(pa.array(many)))
    for i in range(0, 500, 7):
        for j in range(0, 500, 11):
            assert len(set(sets[i].tolist()) & set(sets[j].tolist())) == len(shingles(many[i]) & shingles(many[j]))


def test_components(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 300, 220), rng.integers(0, 300, 220)
    chain = np.arange(1000, 1200)
    a, b = np.concatenate([a, chain]), np.concatenate([b, chain + 1])
    node, root = forest(a.astype(np.int64), b.astype(np.int64))
    want = dict(zip(node.tolist(), root.tolist(), strict=True))
    want |= {r: r for r in root.tolist()}
    edges = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == want and all(v <= k for k, v in got.items())


def test_bitmap_links_of_a_family_are_not_held():
    """4,000 near copies are 8e6 pairs of a block; their links take memory by class."""
    rng = np.random.default_rng(2)
    rows = []
    for family in range(2):
        base = rng.integers(0, 1 << 62, 300, np.uint64)
        for k in range(2000):
            s = base.copy()
            s[rng.integers(0, 300, 3)] = rng.integers(0, 1 << 62, 3, np.uint64)
            rows.append((family * 2000 + k, N.bitmap(s, 1024)))
    for j, block in ((0, [0] * 4000), (1, [k % 2 for k in range(4000)])):
        batch = pa.record_batch([pa.array(np.full(4000, 7)), pa.array(np.full(4000, 0)), pa.array(np.full(4000, j)), pa.array([r[0] for r in rows]),
                                 pa.array(block), pa.array(np.full(4000, 300)), pa.array([r[1] for r in rows])], names=["root", "i", "j", "node", "block", "n", "map"])
        tracemalloc.start()
        links = list(N._bounded(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30e6
        a, b = (np.concatenate([x.column(c).to_numpy() for x in links]) for c in "ab")
        node, root = forest(a, b)
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {k: k // 2000 * 2000 for k in range(4000) if k % 2000}


def test_frequent_shingles_stay_within_the_bound(spark):
    met = {**{k: 50_000 for k in range(3)}, **{k: 2_000 for k in range(3, 13)}, **{k: 7 for k in range(13, 40)}}
    df = spark.createDataFrame(list(met.items()), "shingle bigint, met bigint")
    for bound, want in ((2, 0), (4, 3), (13, 13), (39, 13), (40, 40)):
        assert N.frequent(df, bound).shingles.tolist() == list(range(want))


def test_repeated_ids_do_not_fan_out(spark):
    rng = random.Random(8)
    texts = [" ".join(w) for w in family(rng, [f"w{rng.randrange(400)}" for _ in range(80)], 60, 3)]
    rows = [(rng.choice([7, 7, None]), t) for t in texts] + [(None, texts[0])] * 20
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(N.similar(docs, 7, 1500)) == brute(rows)
    grouped = docs.distinct().selectExpr("doc_id", "xxhash64(text) AS text_hash", "text AS node")
    assert N._fetched(docs, grouped, ["node"]).where("text = node").count() == N._fetched(docs, grouped, ["node"]).count() == len(rows)


def test_texts_are_fetched_by_one_plan_at_every_size(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    grouped = docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "1L AS node")
    for df in (N._fetched(docs, grouped, ["node"]), N.representatives(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan


def test_prefixes_are_not_stored(spark, rows, monkeypatch):
    """The prefix columns, most of the rows, are shuffled as they are made, and links found in a chunk go with them."""
    stored = []
    monkeypatch.setattr(N, "persisted", lambda df, name, keep=N.persisted: (stored.append((name, df.columns)), keep(df, name))[1])
    monkeypatch.setattr(N, "CHUNK", 3000)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(N.similar(docs)) == brute(rows)
    assert stored and not any("prefix" in name or "low" in columns for name, columns in stored)


def test_links_among_the_columns():
    """Links lie before the columns of a partition and may fill a batch alone; a column may cross batches."""
    size = lambda low, high: (low << 32) + high
    batches = [[(None, 9, 3)], [(None, 8, 3), (5, 20, size(10, 10))], [(5, 21, size(11, 12))], [(5, 22, size(40, 40)), (6, 23, size(40, 40))]]
    made = (pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["shingle", "node", "other"]) for rows in batches)
    got = [(a, b) for x in N._columns(made) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    assert sorted(got) == [(8, 3), (9, 3), (21, 20)]


def test_a_shingle_shared_by_chance_links_nothing(spark):
    """Long texts of which each has one shingle in common with the next, first in the common order, are no group."""
    texts = []
    for k in range(40):
        words = [f"own{k}x{i}" for i in range(100)]
        texts.append(" ".join([*(f"met{k}x{i}" for i in range(5)), *words, *(f"met{k + 1}x{i}" for i in range(5))]))
    texts += [texts[7] + " tail"]
    sets = [s for _, s in N.shingle_sets(pa.array(texts))]
    shingle, k = np.unique(np.concatenate(sets[:40]), return_counts=True)
    order = N.Order(shingle[k == 1], np.full(int((k == 1).sum()), 2, np.int32))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r["node"] for r in N.candidate_groups(docs, order).collect()}
    assert got == {N._class(sets[7]), N._class(sets[40])}


@pytest.mark.parametrize("light", [1, 3, 16])
def test_groups_hold_every_similar_pair(light, monkeypatch):
    """Whatever columns count as large, in chunks, batches and copies from several tasks."""
    monkeypatch.setattr(N, "LIGHT", light)
    monkeypatch.setattr(N, "CHUNK", 8 * 700)
    rng = random.Random(light)
    words = [f"w{i}" for i in range(50)]
    texts = []
    for size, n, drift in ((4, 6, 2), (50, 25, 2), (250, 40, 5), (900, 20, 12)):
        texts += [" ".join(w) for w in family(rng, rng.choices(words, k=size), n, drift)]
    texts += [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(60)] + texts[::9]
    rng.shuffle(texts)
    sets = {N._class(s): s for _, s in N.shingle_sets(pa.array(texts))}
    every, k = np.unique(np.concatenate(list(sets.values())), return_counts=True)

    class Shared:
        value = N.Order(every[k > 3], k[k > 3].astype(np.int32))

    rows = []
    for part in (texts[::2], texts[1::2]):
        for x in N._prefixes(Shared)(iter([pa.record_batch([pa.array(part)], names=["text"])])):
            rows += zip(*(c.to_pylist() for c in x.columns), strict=True)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    cuts = sorted(rng.sample(range(1, len(rows)), 60))
    batches = (pa.record_batch([pa.array([r[c] for r in rows[a:b]], pa.int64()) for c in range(3)], names=["shingle", "node", "other"])
               for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True))
    met = {}
    for x in N._columns(batches):
        for a, b, need in zip(*(c.to_pylist() for c in x.columns), strict=True):
            had = met.get((a, b), (0, need))
            met[a, b] = had[0] + 1, min(had[1], need)
    kept = [p for p, (n, need) in met.items() if n >= need]
    node, root = forest(np.array([p[0] for p in kept], np.int64), np.array([p[1] for p in kept], np.int64))
    label = dict(zip(node.tolist(), root.tolist(), strict=True))
    similar = 0
    for a, s in sets.items():
        for b, t in sets.items():
            both = len(np.intersect1d(s, t))
            if a < b and both and N.NUM * (len(s) + len(t) - both) <= N.DEN * both:
                similar += 1
                assert label.get(a, a) == label.get(b, b)
    assert similar > 100


def test_bitmaps_are_copied_by_bands_of_sizes(spark, monkeypatch):
    """A map of a large group meets the blocks of its own band and of the bands beside it, not all blocks of the group."""
    rng = random.Random(3)
    texts = []
    for band in range(12):
        for _ in range(6):
            w = [f"v{rng.randrange(10**6)}" for _ in range(int(20 * 1.3**band) + 4)]
            texts += [" ".join(w), " ".join([*w, "one", "more"])]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [s for _, s in N.shingle_sets(pa.array(texts))]
    grouped = spark.createDataFrame([(N._class(s), i, len(s)) for i, s in enumerate(sets)], "node bigint, doc_id bigint, n bigint")
    hashes = docs.selectExpr("doc_id", "xxhash64(text) AS text_hash")
    grouped = grouped.join(hashes, "doc_id").selectExpr("node", "1L AS root", "doc_id", "text_hash", "n", "1L AS copies")
    copies = []
    paired = N._paired

    def counted(*args):
        copies.append(paired(*args).count())
        return paired(*args)

    monkeypatch.setattr(N, "_paired", counted)
    monkeypatch.setattr(N, "BITMAP_BLOCK", 2048)
    got = {r["doc_id"]: r["root"] for r in N.tightened(docs, grouped, 8, 10**6).collect()}
    assert copies[0] <= 3 * len(texts)
    assert len(got) == len(texts) and all(got[i] == got[i + 1] for i in range(0, len(texts), 2)) and len(set(got.values())) == len(texts) // 2


def test_folded_bitmaps():
    s = np.random.default_rng(1).integers(0, 1 << 62, 500, np.uint64)
    assert all(N.folded(N.bitmap(s, 4096), bits // 8) == N.bitmap(s, bits) for bits in (256, 1024, 4096))


def test_shuffle_files_go_with_the_write(spark):
    files = lambda: {f.getName() for f in _seq(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in f.getName()}
    _seq = lambda s: [s.apply(k) for k in range(s.size())]
    had = spark.conf.get(CLEANUP_KEY, None)
    before = files()
    df = released(spark.range(1000).repartition(4, "id"), "released")
    for _ in range(50):
        left = {f for f in files() - before if f.endswith(".data")}
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP_KEY, None) == had and df.count() == 1000
