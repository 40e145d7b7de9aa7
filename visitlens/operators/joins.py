"""Join of a large side with hot keys against a small per-key side: only the hot keys are salted.

A sort-merge join sends every row of a key to one task, and AQE cannot split it if a side arrives already
partitioned by the key (two scans it splits by itself; they need none of this). Keys that hold more than
``1 / HOT_SHARE`` of the large side's rows are found by a frequent-items sketch, one aggregate over one
column that the map tasks build and merge: its size is fixed, its error far below that share, so no such key
is missed, and at most ``2 * HOT_SHARE`` keys come out, which travel as literals. Rows of a hot key get a
deterministic salt and the small side repeats its rows of that key once per salt; all other rows keep salt 0
and one copy. The large side is read twice, so callers pass a stored one, or the hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
#: A key is hot if it holds more than this fraction (one in so many) of the rows.
HOT_SHARE = 200
SALT = "__salt"
#: Entries of the sketch: counts are at most some 3.5 / TRACKED of the rows too high, and never too low.
TRACKED = 8192


def hot_keys(big: DataFrame, key: str, share: int = HOT_SHARE, tracked: int = TRACKED) -> list:
    """Keys of ``big`` with more than one in ``share`` of its rows, and perhaps some just below that."""
    known = big.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    top, total = known.agg(F.expr(f"approx_top_k(k, {2 * share}, {tracked})"), F.count(F.lit(1))).first()
    return [r["item"] for r in top or [] if r["count"] * share > total]


def hot_key_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = SALTS,
                 share: int = HOT_SHARE, hot: list | None = None) -> DataFrame:
    """``big.join(small, key, how)`` with the hot keys of ``big`` (found here, if not given) spread over ``salts`` tasks."""
    if how not in ("inner", "left"):
        raise ValueError("hot_key_join keeps big's rows: use an inner or left join")
    if hot is None:
        hot = hot_keys(big, key, share)
    if not hot:
        return big.join(small, key, how)
    is_hot: Column = F.coalesce(F.col(key).isin(hot), F.lit(False))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts))
    salt = F.when(is_hot, spread).otherwise(F.lit(0)).cast("int")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return (big.withColumn(SALT, salt)
               .join(small.withColumn(SALT, F.explode(every)), [key, SALT], how)
               .drop(SALT))
