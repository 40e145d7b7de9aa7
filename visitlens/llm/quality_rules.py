"""Quality rules as a short-circuit cascade ordered by rejections per cost.

A rule is a name and a condition that rejects a document, over statistics of its text (``STATS``) and the
text itself. ``plan_cascade`` times every rule over a sample (cost), takes its share of rejected rows
(selectivity), and sorts by rejections per second. Conditions are then tested in that order inside one
CASE expression, whose later branches are not evaluated once one has rejected. Order changes the work,
never the verdict: a document is kept if and only if no rule rejects it.

``accepted`` returns no statistics, so each stands inside the conditions that need it, base rules are ordered
among the others, and a row that a cheap rule rejects never has its costly statistics computed. ``judge``
returns the base statistics of every row: these are computed once, and the cascade saves the rest.

Statistics are array expressions within the row; nothing is shuffled.

Defined results: a null text counts as empty; a rule whose condition is null does not reject;
repeated rows are judged alike; empty tables give empty results. Only ``doc_id`` and ``text`` are read,
so columns of other names cannot clash.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import persisted, read, words

#: Rows that costs and selectivities are estimated on.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 1 << 15
#: Times that a rule runs over the sample, so that its own time stands out from that of a job.
REPEATS = 4

#: The lines of ``text`` that hold a word.
LINES = r"filter(split(text, '\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"
#: Hash of every 3-word window of the words ``w``, in order.
WINDOWS = """CASE WHEN size(w) >= 4 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))
  ELSE CAST(array() AS array<bigint>) END"""
#: The words that the windows found twice or more in ``h`` cover: sorted with their places, equal ones are neighbours.
COVERED = """transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))), s -> array_distinct(flatten(transform(
  filter(s, (x, j) -> get(s, j - 1).h = x.h OR get(s, j + 1).h = x.h), x -> array(x.i, x.i + 1, x.i + 2)))))[0]"""
#: Statistics as SQL over ``text`` and its words ``w``; a transform over a one-element array names a value. Where
#: no window is repeated, nothing is sorted.
STATS = {
    "n_words": "CAST(size(w) AS BIGINT)",
    "word_chars": "aggregate(w, 0L, (a, x) -> a + char_length(x))",
    "n_symbols": "CAST(regexp_count(text, '[#*$%&|<>]') AS BIGINT)",
    "n_dup_lines": f"transform(array({LINES}), l -> CAST(size(l) - size(array_distinct(l)) AS BIGINT))[0]",
    "n_lines": f"CAST(size({LINES}) AS BIGINT)",
    "n_repeat_words": f"""transform(array({WINDOWS}), h ->
  CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE CAST(size({COVERED}) AS BIGINT) END)[0]""",
}


class Rule(NamedTuple):
    name: str
    rejects: str  #: SQL condition over the columns of the frame


#: Base rules: fixed values of the query contract.
BASE_RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
)
#: The method's own rules.
RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "abs(word_chars - 11 * n_words) > 9 * n_words"),  # mean below 2 or above 20
    Rule("shouted", "2 * regexp_count(text, '!!') > n_words"),
    Rule("no_letters", r"2 * regexp_count(text, '\\p{L}[^\\x20\\x09-\\x0D]*') < n_words"),  # from a word's first letter to its end
)


def with_words(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``text`` (null: empty) and its words ``w``.

    They pass a generator of one row: conditions on them stay above it. Pushed below, a condition would
    split the text anew wherever it names the words.
    """
    text = F.coalesce("text", F.lit(""))
    row = F.struct(text.alias("text"), words(text).alias("w"))
    return docs.select(*keep, F.explode_outer(F.array(row)).alias("row_text")).select(*keep, "row_text.*")


def with_stats(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words`` and ``keep``."""
    rows = with_words(docs, ["doc_id", *keep])
    stats = F.struct(*[F.expr(sql).alias(name) for name, sql in STATS.items()])
    return rows.select("doc_id", "text", *keep, F.explode_outer(F.array(stats)).alias("stats")).select("doc_id", "text", *keep, "stats.*")


def on_text(rule: Rule) -> Rule:
    """``rule`` with each statistic's own expression in place of its name."""
    return Rule(rule.name, re.sub(r"\b(?:" + "|".join(STATS) + r")\b", lambda m: f"({STATS[m[0]]})", rule.rejects))


def plan_cascade(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS,
                 prepare: Callable[[DataFrame], DataFrame] = with_stats) -> list[Rule]:
    """``rules`` by rejections per second on a sample of ``docs``, best first; equal ones by name.

    The sample is a hash-chosen part of the first rows that a scan meets, of texts up to ``SAMPLE_BYTES``;
    it steers the order of evaluation only. It is fetched (at most ``sample_rows`` of them, so that the scan
    stops early) and what the rules read (``prepare``) is stored. A rule's cost is its time over ``REPEATS``
    copies of these rows less the time of the same job without a rule. Half a rejection is added to each, so
    that rules which reject nothing here stand by cost.
    """
    some = docs.select("doc_id", "text").where(f"pmod(xxhash64(doc_id, text), 3) = 0 AND octet_length(text) <= {SAMPLE_BYTES}")
    rows = some.limit(sample_rows).collect()
    sample = persisted(prepare(docs.sparkSession.createDataFrame(rows, some.schema).coalesce(1)), "rules-sample")
    if not sample.count():
        return list(rules)
    copies = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("copy"))

    def timed(rejects: str) -> tuple[int, float]:
        job = copies.select(F.sum(F.expr(f"CAST(coalesce({rejects}, false) AS INT)")))
        job.first()  # compiles
        began = time.perf_counter()
        return job.first()[0], time.perf_counter() - began

    _, idle = timed("copy < 0")

    def rank(r: Rule) -> tuple[float, str]:
        rejected, seconds = timed(r.rejects)
        return -(rejected / REPEATS + 0.5) / max(seconds - idle, 1e-3), r.name

    return sorted(rules, key=rank)


def cascade(rules: Sequence[Rule]) -> Column:
    """True if no rule rejects; rules after the first that does are not evaluated."""
    chain = F.lit(True)
    for r in reversed(rules):
        chain = F.when(F.expr(r.rejects), F.lit(False)).otherwise(chain)
    return chain


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every document."""
    ordered = plan_cascade(docs, rules)
    base = F.expr(" OR ".join(f"({r.rejects})" for r in BASE_RULES))
    rows = with_stats(docs).select("*", base.alias("base_failed"))
    return rows.select("*", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered)).alias("kept"))


def accepted(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that no base rule and no rule rejects, with their own columns."""
    ordered = plan_cascade(docs, [on_text(r) for r in (*BASE_RULES, *rules)], prepare=lambda d: with_words(d, ["doc_id"]))
    rows = with_words(docs.select(F.struct(*docs.columns).alias("row"), "text"), ["row"])
    return rows.where(cascade(ordered)).select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RULES_CTES = r"""
split AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM {docs}
), win AS (
  SELECT n, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 4)
), twice AS (
  SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, a, b, c) AS k FROM win) WHERE k > 1
), covered AS (
  SELECT n, count(DISTINCT i + d)::BIGINT AS n_repeat_words
  FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY n
), stats AS (
  SELECT s.n, doc_id, text, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
         coalesce(c.n_repeat_words, 0) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (n)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
         OR word_chars < 2 * n_words OR word_chars > 20 * n_words
         OR 2 * len(regexp_extract_all(text, '!!')) > n_words
         OR 2 * len(regexp_extract_all(text, '[^\x20\x09-\x0D]*\p{{L}}[^\x20\x09-\x0D]*')) < n_words AS rejected
  FROM stats
)"""
OP10_SQL = f"""WITH {_RULES_CTES.format(docs='documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM judged"""
