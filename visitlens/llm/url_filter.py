"""URL filters: host and path rules, and a listed-URL check by blocked Bloom filter and exact join.

``listed_urls`` reduces a table of listed URLs to distinct canonical ones. ``bloom_filter``
folds them into a blocked Bloom filter: one row per 512-bit block, each key sets one bit in each
of the block's eight words. A probe reads a single block, so the filter is joined on the block
number; its size is fixed by ``max_blocks`` (72 bytes a block), which makes the broadcast safe for
any list. Rows that pass are joined exactly with the list, which takes out the false positives:
the answer never depends on the filter's size.

Defined results: a null URL, or one without ``://``, has empty host and path and is never listed;
repeated rows are judged alike, each on its own; empty tables give empty results; columns besides
``page_id`` and ``url`` are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import LOWER, UPPER, lower_ascii, persisted, read

BITS_PER_URL = 16
BLOCK_BITS = 512
MAX_BLOCKS = 1 << 16  # 4.7 MB of filter at most


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the query contract.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: Site names whose pages make up the list in the registered query.
LISTED_SITES = ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def _after_scheme(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without trailing slashes, sorted query without ``utm_`` fields.

    Scheme and fragment are dropped. Null if the URL has no host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    fields = F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~x.rlike("^utm_")))
    tail = F.array_join(fields, "&")
    return F.when(host != "", F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else nulls. ``rules`` is a short literal list."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def listed_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Distinct canonical URLs of a list, as a shared table that both steps read."""
    key = urls.select(canonical(F.col(column)).alias("listed")).where("listed IS NOT NULL")
    return persisted(key.distinct(), "listed-urls")


def _block(key: str, blocks: int) -> Column:
    return F.expr(f"CAST(pmod(xxhash64({key}), {blocks}) AS INT)")


def _bit(key: str, word: int) -> Column:
    """The bit of ``key`` in one of its block's eight words."""
    return F.expr(f"shiftleft(1L, CAST(shiftright(xxhash64({key}, 'bits'), {6 * word}) & 63 AS INT))")


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """One row per used block: ``block`` and its eight 64-bit words."""
    bits = listed.select(_block("listed", blocks).alias("block"), *(_bit("listed", i).alias(f"w{i}") for i in range(8)))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)))


def n_blocks(listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> int:
    """Blocks for about 16 bits a URL, within the fixed bound."""
    return max(1, min(max_blocks, -(-listed.count() * BITS_PER_URL // BLOCK_BITS)))


def possible_hits(rows: DataFrame, key: str, listed: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``maybe``: whether the filter passes their ``key`` (null keys never pass)."""
    bloom = F.broadcast(bloom_filter(listed, blocks))
    probe = rows.withColumn("block", _block(key, blocks)).join(bloom, "block", "left")
    all_set = F.lit(True)
    for i in range(8):
        all_set = all_set & (F.col(f"w{i}").bitwiseAND(_bit(key, i)) != 0)
    maybe = F.coalesce(F.col(key).isNotNull() & all_set, F.lit(False))
    return probe.select(*rows.columns, maybe.alias("maybe"))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES, blocks: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict``: the longest fitting rule's verdict, else block if listed, else allow.

    ``listed`` comes from ``listed_urls``.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("key"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    flagged = possible_hits(rows, "key", listed, blocks or n_blocks(listed))
    ask = F.col("maybe") & F.col("ruled").isNull()
    out = ["page_id", "host", "path", "rule"]
    settled = flagged.where(~ask).select(*out, F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    # Only possible hits are shuffled. The list is a scan, so a URL that holds many rows is a
    # skewed partition of one side, which adaptive execution splits.
    asked = flagged.where(ask).join(listed, F.col("key") == F.col("listed"), "left")
    found = F.when(F.col("listed").isNotNull(), "block").otherwise("allow")
    return settled.unionByName(asked.select(*out, found.alias("verdict")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page; the list holds the URLs of pages on the listed sites."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    on_list = host_of(F.col("url")).rlike(rf"(^|\.)({'|'.join(LISTED_SITES)})\.")
    return judge(pages, listed_urls(pages.where(on_list)))


_RULE_VALUES = ", ".join(f"('{r.host}', '{r.path}', '{r.text}', '{r.verdict}')" for r in RULES)
OP2_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), part AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                                               lambda x: x <> '' AND NOT regexp_matches(x, '^utm_'))), '&') AS tail
  FROM cut
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN
           regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
           || regexp_replace(path, '/+$', '') || CASE WHEN tail <> '' THEN '?' || tail ELSE '' END END AS key
  FROM part
), rules(rule_host, rule_path, rule, verdict) AS (VALUES {_RULE_VALUES}),
fit AS (
  SELECT k.n, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM keyed k JOIN rules r
    ON (k.host = r.rule_host OR ends_with(k.host, '.' || r.rule_host)) AND starts_with(k.path, r.rule_path)
  GROUP BY k.n
), listed AS (
  SELECT DISTINCT key FROM keyed
  WHERE key IS NOT NULL AND regexp_matches(host, '(^|\.)({'|'.join(LISTED_SITES)})\.')
)
SELECT k.page_id, k.host, k.path, f.rule,
       coalesce(f.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN fit f ON k.n = f.n LEFT JOIN listed l ON k.key = l.key
"""
