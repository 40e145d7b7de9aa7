import hashlib
import random
import zlib

import pytest

from visitlens.llm import sharding as S


def smallest_capacity(sizes, shards):
    """Dynamic programming over all contiguous partitions."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[j], prefix[i] - prefix[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


def key(text):
    return int(hashlib.sha256((text or "").encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("seed,cells", [(1, 4), (2, 16), (3, 8192)])
def test_capacity_is_minimal(spark, seed, cells):
    rng = random.Random(seed)
    groups = sorted((rng.randrange(1 << 60), rng.choice([9, 20, 50, 700])) for _ in range(60))
    df = spark.createDataFrame(groups, "key bigint, size bigint")
    capacity, cuts = S.plan(df, 7, cells)
    assert capacity == smallest_capacity([s for _, s in groups], 7)
    loads = {}
    for k, s in groups:
        n = sum(k >= c for c in cuts)
        loads[n] = loads.get(n, 0) + s
    assert max(loads.values()) <= capacity and len(cuts) <= 6


def test_shards_of_documents(spark):
    rng = random.Random(5)
    texts = [None, "", "é" * 30] + ["w" * rng.randrange(1, 200) for _ in range(80)] + ["hot copy"] * 60
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a", "x"), (7, "w", "x"), (7, "w", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, size string")
    out = S.shard(df, 5).collect()
    assert len(out) == len(rows)
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in out) == want
    sizes = {}
    for r in rows:
        sizes[key(r[1])] = sizes.get(key(r[1]), 0) + len((r[1] or "").encode()) + 8
    load = {}
    for r in out:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert max(load.values()) == smallest_capacity([sizes[k] for k in sorted(sizes)], 5)
    shard_of = {}
    for r in out:
        assert shard_of.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
    for n in load:
        assert sorted(r["slot"] for r in out if r["shard"] == n) == list(range(sum(r["shard"] == n for r in out)))


def test_empty_and_tiny(spark):
    assert S.shard(spark.createDataFrame([], "doc_id bigint, text string"), 24).count() == 0
    one = S.shard(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), 24).collect()
    assert [(r["shard"], r["slot"], r["size"]) for r in one] == [(0, 0, 9)]


@pytest.mark.parametrize("hot", [[300], [300, 250], [9, 300]])
def test_hot_groups_leave_no_shard_empty(spark, hot):
    rows = [(i, f"document {i} " + "w" * 30) for i in range(2000)]
    rows += [(10_000 * (j + 1) + i, f"hot copy {j} " + "x" * 988) for j, n in enumerate(hot) for i in range(n)]
    out = S.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 24).collect()
    load, owner = dict.fromkeys(range(24), 0), {}
    for r in out:
        load[r["shard"]] += r["size"]
        assert owner.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
    # 9 copies are larger than the mean shard of the rest (5,000 bytes) as well, and one group each
    heavy = {owner[zlib.crc32(("hot copy %d " % j + "x" * 988).encode())] for j in range(len(hot))}
    rest = [n for s, n in load.items() if s not in heavy]
    assert len(heavy) == len(hot)
    assert min(rest) > 0 and max(rest) <= 1.6 * min(rest), load


@pytest.mark.parametrize("seed", range(40))
def test_even_cuts_stay_within_the_capacity(seed):
    rng = random.Random(seed)
    cells = [S.Cell(i, 0, n, 1, n) for i, n in enumerate(rng.choice([1, 5, 60, 400]) for _ in range(rng.randrange(1, 40)))]
    shards = rng.randrange(1, 12)
    capacity = smallest_capacity([c.size for c in cells], shards)
    starts = S.even(cells, capacity, shards)
    assert starts == sorted(set(starts)) and starts[0] == 0 and len(starts) <= shards
    assert max(sum(c.size for c in cells[a:b]) for a, b in zip(starts, [*starts[1:], len(cells)], strict=True)) <= capacity
