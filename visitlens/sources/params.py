"""Report parameters from the lenient JSON text the reports are configured with.

``{startDate:"2018-11-01", endDate:"2019-12-28", startAge:"20", endAge:"50", ...}``: unquoted
keys, string values, ``""`` = bound off. Only these four keys are read; the others
(professionals, city, gender, keywords, categoryIds, targetPageFlow) are accepted and ignored.
Parsing is Spark's own JSON reader with ``allowUnquotedFieldNames``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.schemas import REPORT_PARAMS

JSON_OPTIONS = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"}
_PARSED: dict = {}


def parse_params_column(text: Column, failfast: bool = False) -> Column:
    """``from_json`` of a column of parameter texts -> struct(startDate, endDate, startAge, endAge).

    Permissive by default (a malformed text gives a null struct); ``failfast`` raises.
    """
    opts = dict(JSON_OPTIONS, mode="FAILFAST") if failfast else JSON_OPTIONS
    return F.from_json(text, REPORT_PARAMS, opts)


@dataclass(frozen=True)
class VisitFilter:
    """Optional inclusive bounds on visit date (text compare) and user age (numeric)."""

    start_date: str | None = None
    end_date: str | None = None
    start_age: str | None = None
    end_age: str | None = None

    @staticmethod
    def from_json(spark: SparkSession, text: str) -> VisitFilter:
        """Parse one parameter text (a one-row driver-side config read, not data).

        Parsed once per text and process: it is configuration, not input data.
        """
        if text not in _PARSED:
            try:  # a malformed text must not silently turn every bound off
                row = (spark.range(1)
                       .select(parse_params_column(F.lit(text), failfast=True).alias("p"))
                       .select("p.*").first())
            except Exception as e:
                raise ValueError(f"malformed report parameters: {text!r}") from e
            _PARSED[text] = VisitFilter(row["startDate"], row["endDate"], row["startAge"], row["endAge"])
        return _PARSED[text]

    @staticmethod
    def _on(v: str | None) -> bool:
        # "" turns a bound off; a missing key (null) is treated the same way.
        return v is not None and len(v) > 0

    def date_predicate(self, date_col: str = "date") -> Column | None:
        preds = []
        if self._on(self.start_date):
            preds.append(F.col(date_col) >= F.lit(self.start_date))
        if self._on(self.end_date):
            preds.append(F.col(date_col) <= F.lit(self.end_date))
        return _and(preds)

    def age_predicate(self, age_col: str = "age") -> Column | None:
        preds = []
        if self._on(self.start_age):
            preds.append(F.col(age_col) >= F.lit(int(self.start_age)))
        if self._on(self.end_age):
            preds.append(F.col(age_col) <= F.lit(int(self.end_age)))
        return _and(preds)


def _and(preds: list) -> Column | None:
    if not preds:
        return None
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out


def apply(df: DataFrame, pred: Column | None) -> DataFrame:
    return df if pred is None else df.filter(pred)
