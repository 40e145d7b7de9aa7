"""Top-k operators.

* ``top_n``: global top-k -> ``orderBy().limit()`` plans as TakeOrderedAndProject (a per-task
  bounded heap, then a k-row merge), never a full sort.
* ``top_n_per_group`` / ``rank_cut``: ``row_number`` / ``rank`` <= k over a window. Catalyst
  inserts a partial WindowGroupLimit *before* the shuffle, so each map task ships at most k
  rows (plus ties for ``rank``) per group: a group with a third of all rows costs the same
  shuffle as any other group.
* ``incremental_top_n``: the top of growing totals from the old top and the changed totals only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs) -> list:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def top_n(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    return df.orderBy(*_cols(order)).limit(n)


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int,
                    rank_col: str | None = None) -> DataFrame:
    """At most ``n`` rows per group, ties cut by the full ``order`` (make it total)."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


def rank_cut(df: DataFrame, keys: Sequence[str], order: Sequence, n: int,
             rank_col: str | None = None) -> DataFrame:
    """``rank() <= n``: ties at the cut are kept, so a group may return more than n rows."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    rk = rank_col or "__rk"
    out = df.withColumn(rk, F.rank().over(w)).filter(F.col(rk) <= n)
    return out if rank_col else out.drop(rk)


def semi(left: DataFrame, right: DataFrame, keys: Sequence[str], keep: bool = True) -> DataFrame:
    """Rows of ``left`` whose keys (null equals null) are in ``right``, or with ``keep=False`` those that are not."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = one if same is None else same & one
    return left.join(other, same, "left_semi" if keep else "left_anti")


def incremental_top_n(before: DataFrame, changed: DataFrame, keys: Sequence[str], item: Sequence[str],
                      order: Sequence, n: int, rank_col: str) -> DataFrame:
    """At most ``n`` rows per group of ``changed``, given the groups' top ``before`` the change.

    Exact if values only move up in ``order``, which must be total: a row outside the old top that did not
    change still has the ``n`` rows before it that it had, since those only moved up. So the old top and the
    changed rows hold the new top; no other row of a group is read. The changed rows are cut to ``n`` a group
    first (a partial limit in the map tasks); an old row that changed and missed that cut is behind those ``n``
    in its old value, too. Groups without a change are not returned.
    """
    new = top_n_per_group(changed.select(before.columns), keys, order, n)
    stays = semi(semi(before, new, keys), new, [*keys, *item], keep=False)
    return top_n_per_group(new.unionByName(stays), keys, order, n, rank_col)
