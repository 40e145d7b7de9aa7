"""Source divergence audit: how far the term shares of the sources of a language lie apart.

Terms are counted per (lang, source) in the map tasks and summed by (lang, term); a language keeps the terms
of at least ``MIN_DOCS`` of its documents. Kept terms are dealt into words of 64 ids, terms of like frequency
together, and each (group, count) is stored as a bitset of the ids of a word. AND and popcount of two groups'
bitsets give the number of terms that one group has c times and the other d times; each such cell counts once
with the value f of its two shares. Terms that a group lacks need no bitset: with f(c, d) written as
f(c, 0) + f(0, d) - f(0, 0) and a rest, the first two are sums over one group's own levels, f(0, 0) counts
for every kept term, and only the rest needs the joint cells.

All arithmetic is whole-numbered. A task holds the bitsets of one word (64 terms times the groups that have
them, compared in tiles) and a bounded table of sums.

Defined results: null text, lang and source count as ''; every row is a document of its own, so repeated rows
and repeated or null ids all count; groups without kept terms still pair, with count 0 everywhere; a language
without kept terms gives pairs of value 0; ties rank by item; an empty table gives no rows. Only ``lang``,
``source`` and ``text`` are read, so other columns cannot clash; whole texts are read in pieces.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.llm.common import persisted, read, small_batches
from visitlens.llm.pieces import pieces, translation

#: Fixed values of the query contract.
MIN_DOCS, SCALE, TERM_RANKS = 3, 1_000_000_000, 200
#: (source, term) entries that a map task holds before it passes them on.
HELD = 400_000
#: Terms of a bucket on average; a bucket is numbered by one window group.
BUCKET = 16_384
#: Bitset pairs of a tile, and entries of a task's table of sums.
TILE, SUMS = 1 << 21, 1 << 20
SALTS = 32

LETTERS = translation("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, text`` rows to ``lang, source, term, n, docs``, combined while they fit."""
    held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary())):
            uses, docs = held[lang, source]
            had, seen = len(docs), set()
            for words in pieces(text.as_py(), LETTERS):
                uses.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(docs) - had
            if size >= HELD:
                yield from _passed(held)
                held.clear()
                size = 0
    yield from _passed(held)


def _passed(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (uses, docs) in held.items():
        if docs:
            terms = list(docs)
            yield pa.record_batch({
                "lang": pa.repeat(lang, len(terms)), "source": pa.repeat(source, len(terms)),
                "term": pa.array(terms, pa.binary()).cast(pa.string()),
                "n": pa.array([uses[t] for t in terms], pa.int64()), "docs": pa.array(docs.values(), pa.int64())})


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n, first`` of the terms that at least ``min_docs`` documents of the lang have.

    ``lang_n`` is the term's count in the whole lang; ``first`` marks one row per (lang, term).
    """
    part = small_batches(docs).select(*_group(), F.coalesce("text", F.lit("")).alias("text"))
    part = part.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    per = part.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    per = per.select("lang", "source", "term", "n", F.sum("docs").over(whole).alias("lang_docs"),
                     F.sum("n").over(whole).alias("lang_n"),
                     (F.row_number().over(whole.orderBy("source")) == 1).alias("first"))
    return per.where(F.col("lang_docs") >= min_docs).drop("lang_docs")


def _group() -> list[Column]:
    return [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]


def _share(count: str | int, total: str) -> Column:
    """p of a count; decimals, as count times SCALE may pass 64 bits."""
    return F.expr(f"cast(1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0)))"
                  f" div cast({total} + terms as decimal(20,0)) as bigint)")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source): ``gid`` within its lang, ``total`` of kept occurrences, ``terms`` and ``lang_total`` of the lang, ``p0``."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("lang_total"))
    out = docs.select(*_group()).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    out = out.na.fill(0, ["total", "terms", "lang_total"])
    gid = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    p0 = F.when(F.col("terms") > 0, _share(0, "total"))
    return out.select("lang", "source", gid.alias("gid"), "total", "terms", "lang_total", p0.alias("p0"))


def bitsets(rows: DataFrame, terms: int) -> DataFrame:
    """``lang, kind, bucket, word, gid, n, p, p0, bits``: the ids of a word's terms with that count in that group.

    ``kind`` is the magnitude of a term's count in the lang: words of like terms have few levels each.
    """
    buckets = max(1, -(-terms // BUCKET))
    kind, bucket = F.floor(F.log2("lang_n")).cast("int"), F.pmod(F.xxhash64("term"), F.lit(buckets))
    dealt = rows.select("*", kind.alias("kind"), bucket.alias("bucket")).repartition("lang", "kind", "bucket")
    turn = F.dense_rank().over(Window.partitionBy("lang", "kind", "bucket").orderBy("term")) - 1
    dealt = dealt.select("*", turn.alias("id")).select("*", F.expr("id div 64").alias("word"))
    return dealt.groupBy("lang", "kind", "bucket", "word", "gid", "n", "p", "p0").agg(
        F.expr("bit_or(shiftleft(1L, cast(id % 64 as int)))").alias("bits"))


def _value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Sums:
    """Sums by (group, group), emitted when the table is full."""

    def __init__(self):
        self.keys, self.values, self.size = [], [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys.append(keys)
        self.values.append(values)
        self.size += len(keys)
        if self.size > SUMS:
            self.fold()

    def fold(self) -> None:
        if self.keys:
            keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate(self.values))
            self.keys, self.values, self.size = [keys], [total], len(keys)

    def passed(self, lang: str) -> Iterator[pa.RecordBatch]:
        self.fold()
        if self.size:
            keys, values = self.keys[0], self.values[0]
            yield pa.record_batch({"lang": pa.repeat(lang, len(keys)), "g": pa.array(keys >> 32), "h": pa.array(keys & 0xFFFFFFFF),
                                   "value": pa.array(values)})
        self.__init__()


def _word_cells(gid: np.ndarray, p: np.ndarray, p0: np.ndarray, bits: np.ndarray, sums: _Sums) -> None:
    """Add the rests of the joint cells of one word's bitsets."""
    step, bits = max(1, TILE // len(bits)), bits.view(np.uint64)  # popcounts of signed words are of absolute values
    for start in range(0, len(bits), step):
        cells = np.bitwise_count(bits[start : start + step, None] & bits[None, :])
        i, j = np.nonzero(cells)
        count = cells[i, j].astype(np.int64)
        i += start
        other = gid[i] != gid[j]
        i, j, count = i[other], j[other], count[other]
        rest = _value(p[i], p[j]) - _value(p[i], p0[j]) - _value(p0[i], p[j]) + _value(p0[i], p0[j])
        sums.add((gid[i] << 32) | gid[j], count * rest)


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitset rows in order of lang and word to ``lang, g, h, value``, summed over the words of a task."""
    sums, lang, rest = _Sums(), None, None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        langs = table.column(0).chunk(0).dictionary_encode()
        columns = [langs.indices.to_numpy()] + [table.column(k).chunk(0).to_numpy() for k in range(1, 8)]
        change = np.zeros(max(len(table) - 1, 0), bool)
        for column in columns[:4]:
            change |= column[1:] != column[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(change) + 1])
        for start, stop in zip(bounds[:-1], bounds[1:]):
            name = langs.dictionary[int(columns[0][start])].as_py()
            if name != lang:
                yield from sums.passed(lang)
                lang = name
            _word_cells(*(c[start:stop] for c in columns[4:]), sums)
            if sums.size > SUMS // 2 and len(sums.keys) == 1:
                yield from sums.passed(lang)
        rest = table.slice(bounds[-1]).combine_chunks().to_batches()[0] if len(table) else None
    if rest is not None:
        name = rest.column(0)[0].as_py()
        if name != lang:
            yield from sums.passed(lang)
            lang = name
        _word_cells(*(rest.column(k).to_numpy() for k in range(4, 8)), sums)
    yield from sums.passed(lang)


def joint_cells(bits: DataFrame) -> DataFrame:
    """``lang, g, h, value``: the rests over terms that both groups have, in parts to be summed."""
    order = ["lang", "kind", "bucket", "word"]
    rows = bits.sortWithinPartitions(*order).select(*order, "gid", "p", "p0", "bits")
    return rows.mapInArrow(_joint, "lang string, g bigint, h bigint, value bigint")


def level_sums(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, g, h, value``: what each group's own levels add to its pairs, by complement."""
    levels = rows.groupBy("lang", "gid", "n", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    levels = levels.select("*", F.pmod("n", F.lit(SALTS)).alias("salt"))
    others = groups.where(F.col("terms") > 0).select("lang", F.col("gid").alias("other"), F.col("p0").alias("q0"),
                                                     F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    pairs = levels.join(others, ["lang", "salt"]).where("gid <> other")
    both = F.array(
        F.struct(F.col("gid").alias("g"), F.col("other").alias("h"), F.expr(f"m * ({_f('p', 'q0')} - {_f('p0', 'q0')})").alias("value")),
        F.struct(F.col("other").alias("g"), F.col("gid").alias("h"), F.expr(f"m * ({_f('q0', 'p')} - {_f('q0', 'p0')})").alias("value")))
    return pairs.select("lang", F.explode(both).alias("one")).select("lang", "one.*")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergence of every pair of sources, and the terms that stand out."""
    kept = persisted(kept_terms(docs, min_docs), "divergence-kept")
    groups = persisted(group_table(docs, kept), "divergence-groups")
    rows = kept.join(groups, ["lang", "source"]).select("*", _share("n", "total").alias("p"))
    parts = joint_cells(bitsets(rows, kept.where("first").count())).unionByName(level_sums(rows, groups))
    sums = parts.groupBy("lang", "g", "h").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("sum"))
    one = groups.select("lang", F.col("gid").alias("g"), "source", "p0", "terms")
    two = groups.select("lang", F.col("gid").alias("h"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = one.join(two, "lang").where("g <> h").join(sums, ["lang", "g", "h"], "left")
    zero = F.expr(f"if(terms = 0, 0L, {_f('p0', 'q0')})").cast("decimal(20,0)") * F.col("terms")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item",
                         (zero + F.coalesce("sum", F.lit(0))).cast("long").alias("value"))
    terms = rows.select("*", _share("lang_n", "lang_total").alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                         F.expr(_f("p", "q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.select("*", rank.alias("rank"))
    return ranked.unionByName(terms.select("*", rank.alias("rank")).where(F.col("rank") <= ranks))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and leading terms of every (lang, source) of ``documents``."""
    return audit(read(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
tok AS (
  SELECT lang, source, rid, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
),
per AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM tok GROUP BY ALL),
kept AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS lang_n FROM per GROUP BY lang, term HAVING sum(docs) >= {MIN_DOCS}
),
lang_sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
grp AS (
  SELECT g.lang, g.source, coalesce(any_value(v), 0) AS v, any_value(lang_total) AS lang_total,
         coalesce(sum(per.n) FILTER (WHERE kept.term IS NOT NULL), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN lang_sizes ON g.lang = lang_sizes.lang
  LEFT JOIN per ON g.lang = per.lang AND g.source = per.source
  LEFT JOIN kept ON per.lang = kept.lang AND per.term = kept.term
  GROUP BY g.lang, g.source
),
cell AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(per.n, 0) AS n,
         1 + (CAST({SCALE} AS HUGEINT) * (coalesce(per.n, 0) + 1)) // (grp.total + grp.v) AS p,
         1 + (CAST({SCALE} AS HUGEINT) * (kept.lang_n + 1)) // (grp.lang_total + grp.v) AS lang_p
  FROM grp JOIN kept ON grp.lang = kept.lang
  LEFT JOIN per ON per.lang = grp.lang AND per.source = grp.source AND per.term = kept.term
),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - lang_p) * (p - lang_p) // lang_p AS BIGINT) AS value
  FROM cell WHERE n > 0 AND p > lang_p
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms
QUALIFY rank <= {TERM_RANKS}
"""
