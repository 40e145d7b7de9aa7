"""Minimax contiguous sharding: the smallest shard capacity over ordered atomic groups, then the cuts.

Documents with equal texts form a group that stays together. Groups are ordered by a 60-bit hash of
the text; ``n`` contiguous runs of them become the shards, with the largest shard as small as it can
be. A capacity is feasible if filling shards greedily in order needs at most ``n`` of them; the
smallest feasible capacity is found by binary search. Where one group alone sets the capacity, filling
every shard up to it would leave others empty: cells above the mean of the rest get a shard of their own
and the runs between them share the other shards evenly, still within the capacity (``even``).

The search runs over a bounded summary on the driver: ``CELLS`` ranges of the key space with their
bytes, number of groups and largest group. Taking cells of several groups as divisible bounds the
capacity from below, taking them as atomic bounds it from above. Until both bounds meet, the cells in
which a cut may fall are split further by one more aggregation over the groups, down to single
groups, so the result is exact at any input size while the driver holds thousands of numbers. A
document's shard is a comparison of its own key with the cuts; no join is needed.

Defined results: null and empty texts have 0 bytes and form one group; with fewer groups than shards
the last shards are empty; repeated rows keep one slot each; an empty table gives no rows. Only
``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.llm.common import persisted, read

#: Fixed values of the query contract.
SHARDS, EXTRA_BYTES = 24, 8
KEY_BITS = 60
CELLS = 8192
#: Rows of one slot-numbering group, about; each shard is dealt to that many more groups.
SLOT_ROWS, LEAST_SALTS = 500_000, 16


class Cell(NamedTuple):
    """Groups with keys in [lo, lo + 2^bits); ``lo`` is a multiple of 2^bits."""

    lo: int
    bits: int
    size: int
    groups: int
    largest: int


def text_key(text: Column) -> Column:
    """The first 60 bits of the text's SHA-256, as a long."""
    return F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, KEY_BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, key`` of every document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + EXTRA_BYTES).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), text_key(text).alias("key"))


def split_cells(groups: DataFrame, cells: list[Cell], parts: int) -> list[Cell]:
    """Each of ``cells`` in 2^``parts`` equal key ranges, measured by one aggregation; empty ones are left out.

    Cells are prefixes of the key, so a group is looked up among those of each width by set membership.
    """
    inside, bits = F.lit(False), F.lit(0)
    for width in sorted({c.bits for c in cells}):
        here = F.shiftright("key", width).isin([c.lo >> width for c in cells if c.bits == width])
        inside = inside | here
        bits = F.when(here, F.lit(max(width - parts, 0))).otherwise(bits)
    low, high = min(c.lo for c in cells), max(c.lo + (1 << c.bits) for c in cells)
    near = groups.where((F.col("key") >= low) & (F.col("key") < high)).where(inside).withColumn("bits", bits)
    lo = F.expr("shiftleft(shiftright(key, bits), bits)")
    rows = near.groupBy(lo.alias("lo"), "bits").agg(
        F.sum("size").alias("size"), F.count("*").alias("groups"), F.max("size").alias("largest")).collect()
    return sorted(Cell(*r) for r in rows)


def greedy(cells: list[Cell], capacity: int, shards: int) -> list[int] | None:
    """Start of each shard as an index into ``cells``, filled in order; None if they do not fit."""
    starts, room = [0], capacity
    for i, c in enumerate(cells):
        if c.size > capacity:
            return None
        if c.size > room:
            starts.append(i)
            room = capacity
            if len(starts) > shards:
                return None
        room -= c.size
    return starts


def _reach(cells: list[Cell], capacity: int, shards: int) -> list[int]:
    """As ``greedy``, with cells of several groups divisible: the cell each shard's end falls in."""
    ends, i, used = [], 0, 0
    for _ in range(shards):
        room = capacity
        while i < len(cells):
            left = cells[i].size - used
            if left <= room:
                room, i, used = room - left, i + 1, 0
            elif cells[i].groups > 1:
                used += room
                break
            else:
                break
        ends.append(i)
    return ends


def _smallest(low: int, high: int, feasible) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def _stops(cells: list[Cell], capacity: int, shards: int) -> list[int]:
    """Least cell that each shard's end can be in, if a capacity is at least ``capacity``."""
    out, i = [], 0
    for _ in range(shards):
        room = capacity
        while i < len(cells) and cells[i].size <= room:
            room -= cells[i].size
            i += 1
        out.append(i)
    return out


def bounds(cells: list[Cell], shards: int) -> tuple[int, int]:
    """The smallest feasible capacity with divisible and with atomic cells."""
    total = sum(c.size for c in cells)
    low = max([-(-total // shards), *(c.largest for c in cells)])
    high = -(-total // shards) + max(c.size for c in cells)
    return (_smallest(low, high, lambda x: _reach(cells, x, shards)[-1] == len(cells)),
            _smallest(low, high, lambda x: greedy(cells, x, shards) is not None))


def _run_starts(cells: list[Cell], first: int, end: int, shards: int) -> list[int]:
    """Starts of ``shards`` runs (fewer, if there are fewer cells) of cells [first, end), each cut as near its even share as it can be."""
    left, starts, i = sum(c.size for c in cells[first:end]), [], first
    for k in range(min(shards, end - first), 0, -1):
        starts.append(i)
        share, load, most = left / k, 0, end - (k - 1)
        while i < most and (not load or load + cells[i].size / 2 <= share):
            load, i = load + cells[i].size, i + 1
        left -= load
    return starts


def even(cells: list[Cell], capacity: int, shards: int) -> list[int]:
    """Starts of the shards within ``capacity``, as even as the cells above the mean of the rest allow; else ``greedy``'s."""
    total, hot = sum(c.size for c in cells), set()
    while len(hot) < shards:
        mean = (total - sum(cells[i].size for i in hot)) / (shards - len(hot))
        more = {i for i, c in enumerate(cells) if c.size > mean}
        if more <= hot:
            break
        hot |= more
    edges = [-1, *sorted(hot), len(cells)]
    runs = [(a + 1, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a + 1]
    spare = shards - len(hot) - len(runs)
    fallback = greedy(cells, capacity, shards)
    if spare < 0:
        return fallback
    size = {r: sum(c.size for c in cells[r[0]:r[1]]) for r in runs}
    share = dict.fromkeys(runs, 1)
    for _ in range(spare):
        wider = [r for r in runs if share[r] < r[1] - r[0]]
        if wider:
            share[max(wider, key=lambda r: size[r] / share[r])] += 1
    starts = sorted([*hot, *(i for r in runs for i in _run_starts(cells, *r, share[r]))])
    loads = [sum(c.size for c in cells[a:b]) for a, b in zip(starts, [*starts[1:], len(cells)], strict=True)]
    return starts if max(loads) <= capacity else fallback


def plan(groups: DataFrame, shards: int = SHARDS, cells_per_round: int = CELLS) -> tuple[int, list[int]]:
    """(capacity, first key of each shard but the first) for ``groups`` (``key``, ``size``)."""
    cells = split_cells(groups, [Cell(0, KEY_BITS, 0, 0, 0)], cells_per_round.bit_length() - 1)
    if not cells:
        return 0, []
    while True:
        least, most = bounds(cells, shards)
        if least == most:
            return most, [cells[i].lo for i in even(cells, most, shards)[1:]]
        ends = zip(_stops(cells, least, shards), _reach(cells, most, shards), strict=True)
        open_cells = sorted({i for a, b in ends for i in range(a, min(b + 1, len(cells))) if cells[i].groups > 1})
        chosen = [cells[i] for i in open_cells]
        fine = split_cells(groups, chosen, max(1, (cells_per_round // len(chosen)).bit_length() - 1))
        taken = set(open_cells)
        cells = sorted([c for i, c in enumerate(cells) if i not in taken] + fine)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``; slots run from 0 without gaps in every shard."""
    rows = persisted(measured(docs), "shard-rows")
    per_key = rows.groupBy("key").agg(F.sum("size").alias("size"))
    groups = persisted(per_key.repartitionByRange("key").sortWithinPartitions("key"), "shard-groups")
    _, cuts = plan(groups, shards)
    at = F.lit(0)
    for cut in cuts:
        at = at + (F.col("key") >= cut).cast("int")
    n = rows.count()
    salts = max(LEAST_SALTS, n // (shards * SLOT_ROWS))
    dealt = rows.select("*", at.alias("shard"), F.expr(f"CAST(pmod(xxhash64(doc_id), {salts}) AS INT)").alias("salt"))
    # One row per shard and salt: at most n / SLOT_ROWS rows beyond shards * LEAST_SALTS.
    counts = dealt.groupBy("shard", "salt").agg(F.count("*").alias("k"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "salt", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "salt").orderBy("doc_id", "key", "size")
    placed = dealt.withColumn("turn", F.row_number().over(order)).join(F.broadcast(offsets), ["shard", "salt"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("turn") - 1).alias("slot"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law ``bytes``."""
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
