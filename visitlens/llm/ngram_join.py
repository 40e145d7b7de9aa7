"""N-gram Jaccard join: blocked sparse products of the document by shingle incidence.

A document's set is its distinct 5-word shingles (hashed to 64 bits). Equal sets are one class and take
part once. Two sets of Jaccard similarity 0.8 or more share ``l`` shingles among the first
``n - ceil(0.8 n) + l`` of either, whatever the common order of shingles and ``l`` (up to ``ceil(0.8 n)``, here it grows
with ``n``); ordering frequent shingles last keeps shared passages out of these prefixes. Classes that meet in so many
prefix columns are linked; one shingle that two texts have in common by chance, which with the rows would join all
long texts, links nothing. Columns of more than ``LIGHT`` classes link all of theirs (as a chain, never as all pairs),
so the groups hold every similar pair; only classes in such groups go on.

Groups that fill more than a block are tightened first: each class folds its set into a bitmap, whose
differing bits bound the sets' difference from below, and only pairs within the bound that their sizes
set still link a group. Classes are dealt there by bands of sizes, each compared with itself and the next, so a class
is copied as often as these bands have blocks, not the group. Within a group the incidence matrix is multiplied with its transpose, in blocks of classes: a task holds
two blocks, adds up overlaps a strip of columns at a time, rarest first, and drops pairs whose overlap and
what is left of either set cannot reach the bound that their sizes set. Large groups are many block pairs.
What survives all strips has exact overlaps; each task returns, per class, the least class it reaches and
its number of links. Components are then joined by ``components``.

Which shingles count as frequent (met twice or more in a chunk of the scan; the ``FREQUENT`` most
frequent are broadcast, 12 bytes each) steers the work and never the result: any order is right.

Defined results: null texts and texts without words have empty sets and are linked with nothing; fewer
words than five are one shingle; repeated rows are copies of each other; a component's id is its least
``doc_id`` and null only if all are null; an empty table gives no rows. Only ``doc_id`` and ``text`` are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.llm import tokens
from visitlens.llm.common import read, small_batches
from visitlens.llm.common import released as persisted
from visitlens.llm.components import components, forest

WORDS = 5
#: Similarity as a fraction: linked if NUM * union <= DEN * intersection.
NUM, DEN = 4, 5
#: Broadcast bound of the frequent shingles, and shingles counted together in one task.
FREQUENT, CHUNK = 1 << 20, 4_000_000
#: Prefix columns of so many classes count towards the shingles that a pair must share; a larger one links its classes alone.
LIGHT = 16
#: Sizes of a band differ by this factor at most; above 5/4, so that similar sets lie in one band or in neighbours.
BAND = 1.26
#: A block holds about so many classes and shingles at most; a strip so many columns.
BLOCK_CLASSES, BLOCK_SHINGLES, STRIP = 256, 500_000, 4096
#: Bitmaps have two bits a shingle of the group's largest set; a block holds so many bytes of them.
BITMAP_BITS, BITMAP_BLOCK = 2, 4 << 20

#: Powers of an odd constant: no two placings of the same words share a sum, as they may with steps of equal difference.
_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row; nulls and texts without words give empty sets."""
    with np.errstate(over="ignore"):
        for first, h, at in tokens.slices(texts, tokens.word_classes(), lower=True):
            full = max(len(h) - WORDS + 1, 0)
            value = np.zeros(full, np.uint64)
            for k in range(WORDS if full else 0):
                value += h[k : k + full] * _STEP[k]
            value = tokens.mix(value)
            for r in range(len(at) - 1):
                a, n = int(at[r]), int(at[r + 1] - at[r])
                if n >= WORDS:
                    yield first + r, np.unique(value[a : a + n - WORDS + 1])
                elif n:
                    own = (h[a : a + n] * _STEP[:n]).sum(dtype=np.uint64) + np.uint64(n)
                    yield first + r, tokens.mix(tokens.mix(np.array([own])))
                else:
                    yield first + r, np.zeros(0, np.uint64)


def _class(shingles: np.ndarray) -> int:
    """64 bits that stand for a set, as a signed long."""
    with np.errstate(over="ignore"):
        total = tokens.mix(shingles + np.uint64(len(shingles))).sum(dtype=np.uint64)
    return int(tokens.mix(np.array([total])).view(np.int64)[0])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (``n``, ``node``), and rows of shingles met twice in a chunk (``shingle``, ``met``)."""
    held: dict[int, np.ndarray] = {}
    size = 0

    def counted() -> pa.RecordBatch:
        every = np.concatenate([*held.values(), np.zeros(0, np.uint64)])
        held.clear()
        every.sort()
        u = np.unique(every[1:][every[1:] == every[:-1]])
        k = np.searchsorted(every, u, "right") - np.searchsorted(every, u, "left")
        none = pa.nulls(len(u), pa.int64())
        return pa.record_batch([none, none, none, none, _signed(u), pa.array(k, pa.int64())], names=names)

    names = ["doc_id", "text_hash", "n", "node", "shingle", "met"]
    for batch in batches:
        n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for row, s in shingle_sets(batch.column(1)):
            n[row] = len(s)
            node[row] = own = _class(s)
            if len(s) and own not in held:
                held[own] = s
                size += len(s)
            if size >= CHUNK:
                yield counted()
                size = 0
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n), pa.array(node), none, none], names=names)
    if size:
        yield counted()


class Order:
    """Common order of shingles: by how often they were met, then by hash."""

    def __init__(self, shingles: np.ndarray, met: np.ndarray):
        by = np.argsort(shingles)
        self.shingles, self.met = shingles[by], met[by]

    def ranked(self, s: np.ndarray) -> np.ndarray:
        """The sorted ``s`` with frequent shingles last."""
        if not len(self.shingles):
            return s
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        met = np.where(self.shingles[at] == s, self.met[at], 0)
        return s[np.argsort(met, kind="stable")]


def frequent(described: DataFrame, bound: int = FREQUENT) -> Order:
    """The most frequent shingles, ``bound`` at most: all that were met at least so often that they fit; none if the top level is too large."""
    met = persisted(described.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("met").alias("met")), "met")
    # Counts to 1000 have a level each, those above 16 for each doubling: some 1,900 levels whatever the input.
    level = F.when(F.col("met") <= 1000, F.col("met")).otherwise(1001 + F.floor(16 * F.log2(F.col("met") / 1000)))
    rows = met.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    least, total = None, 0
    for r in rows:
        total += r["count"]
        if total > bound:
            break
        least = r["level"]
    table = met.where(F.lit(False) if least is None else level >= least).toArrow()
    values = [table.column(c).to_numpy() for c in ("shingle", "met")]
    return Order(values[0].astype(np.int64).view(np.uint64), np.minimum(values[1], 1 << 30).astype(np.int32))


def needed(n):
    """How many prefix shingles a set of ``n`` must share with a similar one that is not smaller."""
    return np.minimum(-(-NUM * n // DEN), 2 + n // 256)


def prefix_length(n: int) -> int:
    return int(n - -(-NUM * n // DEN) + needed(n))


def _prefixes(order) -> callable:
    """Per chunk of documents: prefix columns, those of more than ``LIGHT`` classes chained already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = order.value
        parts: list[tuple[np.ndarray, int, int]] = []
        seen: set[int] = set()
        size = 0

        def combined() -> Iterator[pa.RecordBatch]:
            count = [len(p[0]) for p in parts]
            shingle = np.concatenate([p[0] for p in parts])
            node = np.repeat(np.array([p[1] for p in parts], np.int64), count)
            n = np.repeat(np.array([p[2] for p in parts], np.int64), count)
            by = np.lexsort((n, shingle))
            shingle, node, n = shingle[by], node[by], n[by]
            _, column, k = np.unique(shingle, return_inverse=True, return_counts=True)
            heavy = (k > LIGHT)[column]
            a, b, starts, high = chained(shingle[heavy], node[heavy], n[heavy], n[heavy])
            at = np.flatnonzero(heavy)[starts]
            yield from _rows(shingle[at], node[at], n[at], high + HEAVY, *forest(a, b))
            yield from _rows(shingle[~heavy], node[~heavy], n[~heavy], n[~heavy], a[:0], b[:0])

        for batch in batches:
            for _, s in shingle_sets(batch.column(0)):
                if not len(s):
                    continue
                node = _class(s)
                if node in seen:
                    continue
                seen.add(node)
                head = ranked.ranked(s)[: prefix_length(len(s))].copy()  # else the whole set stays
                parts.append((head, node, len(s)))
                size += len(head)
                if size >= CHUNK // 8:
                    yield from combined()
                    parts, seen, size = [], set(), 0
        if parts:
            yield from combined()

    return run


#: Marks a row that stands for a run of a column of more than ``LIGHT`` classes.
HEAVY = 1 << 31


def _rows(shingle, node, low, high, a, b) -> Iterator[pa.RecordBatch]:
    """Columns (``shingle, node`` and in ``other`` both sizes, ``low`` above) and links (no shingle, ``node`` and in ``other`` its root)."""
    names = ["shingle", "node", "other"]
    if len(shingle):
        yield pa.record_batch([_signed(shingle), pa.array(node), pa.array((low.astype(np.int64) << 32) + high)], names=names)
    if len(a):
        yield pa.record_batch([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=names)


def chained(shingle, node, low, high) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between neighbours of a column whose sizes may match, and the runs that these make.

    Rows are sorted by ``shingle`` and ``low``; ``low`` and ``high`` bound the sizes of the classes a row
    stands for. Returns the links (two arrays), the first row of each run and the run's largest size.
    """
    new = np.ones(len(shingle), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    column = np.cumsum(new)
    top = np.maximum.accumulate(column * (1 << 32) + high) - column * (1 << 32)
    fits = ~new
    fits[1:] &= top[:-1] * DEN >= low[1:].astype(np.int64) * NUM
    at = np.flatnonzero(fits)
    starts = np.flatnonzero(~fits)
    ends = np.append(starts[1:], len(shingle)) - 1
    return node[at - 1], node[at], starts, top[ends] if len(starts) else top


def _closed(shingle, node, low, high, heavy) -> tuple[tuple, tuple]:
    """Links (two arrays) that whole heavy columns make by themselves, and pairs of the others (three, with the number of columns needed)."""
    new = np.ones(len(shingle), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    column = np.cumsum(new) - 1
    strong = ((np.bincount(column) > LIGHT) | (np.bincount(column, heavy) > 0))[column] if len(column) else heavy
    x, y, _, _ = chained(shingle[strong], node[strong], low[strong], high[strong])
    column, node, n = column[~strong], node[~strong], low[~strong]
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, LIGHT):
        at = np.flatnonzero(column[d:] == column[:-d])
        if not len(at):
            break
        at = at[n[at] * DEN >= n[at + d] * NUM]
        first.append(at)
        second.append(at + d)
    p, q = np.concatenate(first), np.concatenate(second)
    return (x[x != y], y[x != y]), (np.maximum(node[p], node[q]), np.minimum(node[p], node[q]), needed(n[p]))


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by shingle, other and node, and those among its rows.

    ``need`` is 0 for links that hold, as forests of stars; others are pairs that met in one more column, and hold
    if there are ``need`` of them. The open column's rows are kept, those of a heavy one as the last, which stands for its run.
    """
    last = None
    a, b, pairs, size = [], [], [], 0

    def found() -> Iterator[pa.RecordBatch]:
        if a:
            node, root = forest(np.concatenate(a), np.concatenate(b))
            yield pa.record_batch([pa.array(node), pa.array(root), pa.array(np.zeros(len(node), np.int32))], names=["a", "b", "need"])
        for x, y, need in pairs:
            yield pa.record_batch([pa.array(x), pa.array(y), pa.array(need.astype(np.int32))], names=["a", "b", "need"])

    def take(links: tuple, light: tuple) -> int:
        if len(links[0]):
            a.append(links[0])
            b.append(links[1])
        if len(light[0]):
            pairs.append(light)
        return len(links[0]) + len(light[0])

    for batch in batches:
        given = batch.column(0).is_null()
        if batch.column(0).null_count:
            links = batch.filter(given)
            a.append(links.column(1).to_numpy())
            b.append(links.column(2).to_numpy())
            size += links.num_rows
            batch = batch.filter(pc.invert(given))
        shingle, node, sizes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        low, high = sizes >> 32, sizes & (HEAVY - 1)
        cols = [shingle, node, low, high, ((sizes & HEAVY) > 0) | (low != high)]
        if last is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(last, cols, strict=True)]
        if not len(cols[0]):
            continue
        again = np.zeros(len(cols[0]), bool)  # copies come from other chunks
        again[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]) & ~cols[4][1:] & ~cols[4][:-1]
        cols = [c[~again] for c in cols]
        start = int(np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))[-1])
        size += take(*_closed(*(c[:start] for c in cols)))
        last = [c[start:] for c in cols]
        if len(last[0]) > LIGHT or last[4].any():
            x, y, _, top = chained(*last[:4])
            size += take((x[x != y], y[x != y]), (x[:0],))
            last = [c[-1:] for c in last[:3]] + [top[-1:], np.ones(1, bool)]
        if size >= CHUNK // 8:
            yield from found()
            a, b, pairs, size = [], [], [], 0
    if last is not None:
        take(*_closed(*last))
    yield from found()


def candidate_groups(docs: DataFrame, order: Order) -> DataFrame:
    """``node, root``: classes that share enough prefix columns with another class, by group."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    rows = docs.select("text").mapInArrow(_prefixes(shared), "shingle bigint, node bigint, other bigint")
    # The prefixes, by far the most rows, are shuffled as they are made; they are never stored besides.
    dealt = rows.repartition(F.coalesce("shingle", "node")).sortWithinPartitions("shingle", "other", "node")
    met = dealt.mapInArrow(_columns, "a bigint, b bigint, need int").groupBy("a", "b").agg(F.count("*").alias("k"), F.min("need").alias("need"))
    return components(met.where("k >= need").select("a", "b"))


def block_pairs(grouped: DataFrame, block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``grouped`` (``node``, ``root``, ``n``) with its block and the block pairs (``i`` <= ``j``) it belongs to."""
    per = grouped.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("k") / block_classes), F.ceil(F.col("s") / block_shingles)).cast("int")
    per = persisted(per.select(F.col("root").alias("group_root"), blocks.alias("blocks")), "groups")
    out = grouped.join(per, F.col("root") == F.col("group_root")).drop("group_root")
    return out.withColumn("block", F.expr("CAST(pmod(xxhash64(node), blocks) AS INT)"))


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text by the shingles, for rows whose text is that of their class; repeated rows once a task."""
    seen: set[int] = set()
    for batch in batches:
        node = batch.column("node").to_numpy()
        keep, sets = [], []
        for row, s in shingle_sets(batch.column("text")):
            own = _class(s)
            if own == node[row] and own not in seen:
                seen.add(own)
                keep.append(row)
                sets.append(s.tobytes())
        out = batch.drop_columns(["text"]).take(pa.array(keep, pa.int64()))
        yield pa.record_batch([*out.columns, pa.array(sets, pa.binary())], names=[*out.schema.names, "shingles"])


def overlaps(sets: list[np.ndarray], across: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x < y) of ``sets`` similar enough: the product's entries that reach the bound of their sizes.

    ``across``: booleans; only pairs of a true and a false one count. Columns come in strips, rarest
    first; after each, pairs that can no longer reach their bound are dropped, and sets without a pair.
    """
    n = np.array([len(s) for s in sets], np.int64)
    need = -(-NUM * (n[:, None] + n[None, :]) // (NUM + DEN))
    alive = np.triu(np.minimum(n[:, None], n[None, :]) >= need, 1)
    if across is not None:
        alive &= across[:, None] != across[None, :]
    shingle = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), n)
    by = np.argsort(shingle, kind="stable")
    shingle, doc = shingle[by], doc[by]
    new = np.ones(len(shingle), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    column = np.cumsum(new) - 1
    count = np.bincount(column)
    rank = np.full(len(count), -1)
    useful = np.flatnonzero(count > 1)
    rank[useful[np.argsort(count[useful], kind="stable")]] = np.arange(len(useful))
    at = rank[column]
    held = at >= 0
    at, doc = at[held], doc[held]
    by = np.argsort(at, kind="stable")
    at, doc = at[by], doc[by]
    left = np.bincount(doc, minlength=len(sets))
    total = np.zeros((len(sets), len(sets)), np.int64)
    alive &= np.minimum(left[:, None], left[None, :]) >= need
    bounds = np.searchsorted(at, np.arange(0, len(useful) + STRIP, STRIP))
    for strip in range(len(bounds) - 1):
        live = np.flatnonzero(alive.any(axis=0) | alive.any(axis=1))
        if not len(live):
            break
        place = np.full(len(sets), -1)
        place[live] = np.arange(len(live))
        part = slice(bounds[strip], bounds[strip + 1])
        row, col = place[doc[part]], at[part] - strip * STRIP
        left -= np.bincount(doc[part], minlength=len(sets))
        ok = row >= 0
        matrix = np.zeros((len(live), STRIP), np.float32)
        matrix[row[ok], col[ok]] = 1
        matrix = matrix[:, matrix.any(axis=0)]
        total[np.ix_(live, live)] += (matrix @ matrix.T).astype(np.int64)
        alive &= total + np.minimum(left[:, None], left[None, :]) >= need
    return np.nonzero(alive)


def _by_key(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Runs of rows, in a sorted partition, whose first ``size`` fields are equal."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:size] != row[:size]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block pair: ``node``, the least node it reaches there, and its links."""
    for held in _by_key(batches, 3):
        own = {r[3]: r for r in held}  # a class may come from repeated rows
        rows = [own[k] for k in sorted(own)]
        i, j = rows[0][1:3]
        nodes = np.array([r[3] for r in rows], np.int64)
        copies = np.array([r[5] for r in rows], np.int64)
        side = None if i == j else np.array([r[4] == i for r in rows])
        x, y = overlaps([np.frombuffer(r[6], np.uint64) for r in rows], side)
        links = np.bincount(x, copies[y], len(rows)) + np.bincount(y, copies[x], len(rows))
        reach = dict(zip(*(v.tolist() for v in forest(nodes[x], nodes[y])), strict=True))
        found = np.flatnonzero(links > 0)
        yield pa.record_batch([pa.array(nodes[found]), pa.array([reach.get(v, v) for v in nodes[found].tolist()], pa.int64()),
                               pa.array(links[found].astype(np.int64))], names=["node", "least", "links"])


def bitmap(shingles: np.ndarray, bits: int) -> bytes:
    """``bits`` (a power of two, 64 at least) with that of every shingle set."""
    out = np.zeros(bits, bool)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def folded(bits: bytes, width: int) -> bytes:
    """A bitmap of ``width`` bytes, as made with so many bits at once."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0).tobytes()


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block pair of bitmaps: links (as stars) between classes whose sets may be similar enough."""
    for held in _by_key(batches, 3):
        own = {r[3]: r for r in held}
        rows = sorted(own.values(), key=lambda r: r[5])
        i, j = rows[0][1:3]
        nodes, n = np.array([r[3] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64)
        side = np.array([r[4] == i for r in rows])
        width = min(len(r[6]) for r in rows)
        maps = np.frombuffer(b"".join(folded(r[6], width) for r in rows), np.uint64).reshape(len(rows), -1)
        label = np.arange(len(rows))  # pairs within a component are passed over, so that a block's links are never held
        for k in range(len(rows) - 1):
            end = int(np.searchsorted(n, n[k] * DEN // NUM, "right"))
            other = label[k + 1 : end] != label[k]
            if i != j:
                other &= side[k + 1 : end] != side[k]
            at = np.flatnonzero(other) + k + 1
            if len(at):
                apart = np.bitwise_count(maps[at] ^ maps[k]).sum(axis=1, dtype=np.int64)
                near = at[apart * (NUM + DEN) <= (n[at] + n[k]) * (DEN - NUM)]
                if len(near):
                    label[np.isin(label, label[near])] = label[k]
        moved = np.flatnonzero(label != np.arange(len(rows)))
        if len(moved):
            yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def _fetched(docs: DataFrame, grouped: DataFrame, columns: list[str]) -> DataFrame:
    """``text`` and ``columns`` of the documents that ``grouped`` names by ``doc_id`` and ``text_hash``: a shuffled join at every size."""
    texts = docs.select(F.col("doc_id").alias("text_id"), F.xxhash64("text").alias("own_hash"), "text")
    return texts.join(grouped.hint("shuffle_hash"), F.col("text_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))).select("text", *columns)


def _paired(held: DataFrame, columns: list[str], first: str = "0", last: str = "blocks - 1") -> DataFrame:
    """Rows of blocks dealt and sorted by the block pairs (``root, i, j``) that they belong to: those with blocks ``first`` to ``last``."""
    other = F.explode(F.sequence(F.expr(first), F.expr(last))).alias("other")
    pairs = held.select("*", other).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *columns)
    return pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")


def tightened(docs: DataFrame, grouped: DataFrame, block_classes: int, block_shingles: int) -> DataFrame:
    """``grouped`` (``node, root, doc_id, text_hash, n, copies``) with groups beyond one block split by their bitmaps."""
    per = grouped.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.max("n").alias("most"))
    per = persisted(per.withColumnRenamed("root", "group_root"), "group-sizes")
    sized = grouped.join(per, F.col("root") == F.col("group_root")).drop("group_root")
    large = (F.col("k") > block_classes) | (F.col("s") > block_shingles)
    sized = persisted(sized.withColumn("large", large), "sized")
    big = sized.where("large").withColumn("band", F.expr(f"CAST(floor(ln(n) / ln({BAND})) AS INT)"))
    bits = F.expr(f"CAST(greatest(256, power(2, ceil(log2(max(n) * {BITMAP_BITS})))) AS INT)").alias("bits")
    bands = big.groupBy("root", "band").agg(F.count("*").alias("k"), bits)
    bands = bands.withColumn("blocks", F.ceil(F.col("k") * F.col("bits") / (8 * BITMAP_BLOCK)).cast("int"))
    # Blocks are numbered through a group's bands; a class meets those of its band and of the bands beside it.
    by = Window.partitionBy("root").orderBy("band")
    start = (F.sum("blocks").over(by) - F.col("blocks")).cast("int")
    bands = bands.withColumn("start", start).withColumn("end", F.col("start") + F.col("blocks") - 1)
    below, above = F.lag("band").over(by) == F.col("band") - 1, F.lead("band").over(by) == F.col("band") + 1
    first = F.when(below, F.lag("start").over(by)).otherwise(F.col("start")).alias("first")
    last = F.when(above, F.lead("end").over(by)).otherwise(F.col("end")).alias("last")
    bands = persisted(bands.select(F.col("root").alias("group_root"), F.col("band").alias("of"), "bits", "blocks", "start", first, last), "bands")
    big = big.join(bands, (F.col("root") == F.col("group_root")) & (F.col("band") == F.col("of"))).drop("group_root", "of")
    big = persisted(big.withColumn("block", F.expr("start + CAST(pmod(xxhash64(node), blocks) AS INT)")), "large")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _with_sets(batches):
            sets = [bitmap(np.frombuffer(x, np.uint64), m) for x, m in zip(batch.column("shingles").to_pylist(), batch.column("bits").to_pylist(), strict=True)]
            batch = batch.drop_columns(["shingles", "bits"])
            yield pa.record_batch([*batch.columns, pa.array(sets, pa.binary())], names=[*batch.schema.names, "map"])

    held = _fetched(docs, big, ["root", "node", "n", "block", "first", "last", "bits"])
    held = held.mapInArrow(maps, "root bigint, node bigint, n bigint, block int, first int, last int, map binary")
    links = _paired(held, ["node", "block", "n", "map"], "first", "last").mapInArrow(_bounded, "a bigint, b bigint")
    fine = components(links)
    columns = ["node", "root", "doc_id", "text_hash", "n", "copies"]
    return persisted(sized.where("NOT large").select(columns).unionByName(fine.join(big.drop("root"), "node").select(columns)), "tightened")


def _grouped(docs: DataFrame, block_classes: int, block_shingles: int) -> DataFrame:
    """Per document ``doc_id, text_hash, n, root`` (null for an empty set), ``component_id, n_links``."""
    rows = small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _described, "doc_id bigint, text_hash bigint, n bigint, node bigint, shingle bigint, met bigint")
    rows = persisted(rows, "sets")
    described = rows.where("shingle IS NULL").select("doc_id", "text_hash", "n", "node")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    classes = described.where("n > 0").groupBy("node").agg(first, F.max("n").alias("n"), F.count("*").alias("copies"))
    classes = persisted(classes.select("node", "first.doc_id", "first.text_hash", "n", "copies"), "classes")
    groups = persisted(candidate_groups(docs, frequent(rows)), "candidates")
    tight = tightened(docs, groups.join(classes, "node"), block_classes, block_shingles)
    grouped = persisted(block_pairs(tight, block_classes, block_shingles), "grouped")
    held = _fetched(docs, grouped, ["root", "node", "copies", "block", "blocks"])
    held = held.mapInArrow(_with_sets, "root bigint, node bigint, copies bigint, block int, blocks int, shingles binary")
    pairs = _paired(held, ["node", "block", "copies", "shingles"])
    found = persisted(pairs.mapInArrow(_products, "node bigint, least bigint, links bigint"), "products")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    named = classes.join(reached, "node", "left").select("node", "doc_id", "copies", F.coalesce("root", "node").alias("root"))
    named = persisted(named.join(links, "node", "left"), "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select(F.col("node").alias("class"), "root", "component_id",
                                             (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # A scan on both sides, so that a class of very many copies may be split.
    named = persisted(named, "named")
    out = ["doc_id", "text_hash", "n", "root", "component_id", "n_links"]
    full = described.where("n > 0").join(named, F.col("node") == F.col("class")).select(out)
    empty = described.where("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("root"),
                                            F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(empty)


def similar(docs: DataFrame, block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of every document."""
    return _grouped(docs, block_classes, block_shingles).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, that with the least ``doc_id`` (nulls last); rows with empty sets all stay."""
    found = persisted(_grouped(docs, BLOCK_CLASSES, BLOCK_SHINGLES).select("doc_id", "text_hash", "root"), "components")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    chosen = found.where("root IS NOT NULL").groupBy("root").agg(first).select("first.doc_id", "first.text_hash")
    empty = found.where("root IS NULL").select("doc_id", "text_hash").distinct()
    chosen = chosen.select("*", F.lit(True).alias("one")).unionByName(empty.select("*", F.lit(False).alias("one")))
    # Rows that agree in id and text stand for one document.
    k = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("k")).withColumnsRenamed({"doc_id": "k_id", "text_hash": "k_hash"})
    chosen = chosen.join(k, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash")))
    chosen = persisted(chosen.select("k_id", "k_hash", (F.col("one") & (F.col("k") > 1)).alias("repeated")), "chosen")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    rows = rows.join(chosen.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash")))
    once = rows.where("NOT repeated").select("row")
    return once.unionByName(rows.where("repeated").groupBy("id", "hash").agg(F.min("row").alias("row")).select("row")).select("row.*")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and number of links of every document."""
    return similar(read(spark, sf_dir, "documents"))
