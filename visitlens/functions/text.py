"""Scalar column helpers, all built-in expressions (stay in whole-stage codegen)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitlens.fixed import NAME_SEP, PCT_SUFFIX


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_split(col, sep: str = ",") -> Column:
    """``String.split(sep)`` of a Java program for a one-character literal separator.

    Java drops trailing empty parts but keeps leading / inner ones and does not trim:
    ``"1,2,,"`` -> [1, 2]; ``","`` -> []; ``",1"`` -> ["", 1]; ``""`` -> [""]; null -> null.
    Spark's ``split`` keeps trailing empties, so they are cut off before splitting.
    """
    if len(sep) != 1:
        raise ValueError("java_split takes a one-character separator")
    c = _c(col)
    trimmed = F.rtrim(c, F.lit(sep))  # trailing separators only; no regex per row
    esc = re.escape(sep)
    return (F.when(c == "", F.array(F.lit("")))
             .when(trimmed == "", F.array().cast("array<string>"))
             .otherwise(F.split(trimmed, esc)))


def half_up_tenths(ratio) -> Column:
    """Percent with one decimal, rounded half up: floor(r * 1000 + 0.5) / 10 (r in [0, 1])."""
    return F.floor(_c(ratio) * 1000 + 0.5) / 10


def round_half_up_1dp(x) -> Column:
    """floor(x * 10 + 0.5) / 10 for an already-percent value."""
    return F.floor(_c(x) * 10 + 0.5) / 10


def pct_text(name, pct) -> Column:
    """``name:33.3%`` with the double printed the JVM way (``100.0``, ``0.1``)."""
    return F.concat(_c(name), F.lit(NAME_SEP), _c(pct).cast("string"), F.lit(PCT_SUFFIX))


def epoch_ms_to_day(ts_ms) -> Column:
    """Epoch milliseconds -> ``yyyy-MM-dd`` in the session time zone (pinned to UTC)."""
    return F.date_format(F.timestamp_millis(_c(ts_ms)), "yyyy-MM-dd")


def non_empty(col) -> Column:
    """Not null and length > 0."""
    c = _c(col)
    return c.isNotNull() & (F.length(c) > 0)


def ads_json(list_col) -> Column:
    """Array of struct(ads_id, count) in rank order -> ``[{"3":120},{"1":99}]``."""
    return F.to_json(F.transform(_c(list_col), lambda r: F.create_map(r["ads_id"], r["count"])))
