"""The top of growing totals from the old top and the changed totals, against a full ranking."""
import random

import pytest
from pyspark.sql import functions as F

from visitlens.operators.topk import incremental_top_n, semi, top_n_per_group

SCHEMA = "day string, area string, item string, n bigint"


def order():
    return [F.col("n").desc(), F.col("item").asc()]


def ranked(totals, groups, k):
    out = []
    for g in groups:
        own = sorted(((-n, i) for (d, a, i), n in totals.items() if (d, a) == g))[:k]
        out += [(*g, i, -n, place) for place, (n, i) in enumerate(own, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 3])
def test_equals_a_full_ranking_after_every_change(spark, k):
    rng = random.Random(k)
    groups = [("d1", "N"), ("d1", None), (None, "S"), ("d2", "hot")]
    totals, top = {}, []
    for step in range(6):
        changed = {}
        for _ in range(rng.choice([1, 5, 40])):
            g = groups[-1] if rng.random() < 0.4 else rng.choice(groups)
            key = (*g, f"i{rng.randrange(12):02d}")
            changed[key] = changed.get(key, totals.get(key, 0)) + rng.choice([0, 1, 1, 3])  # many ties, also unmoved values
        totals.update(changed)
        before = spark.createDataFrame([r[:4] for r in top], SCHEMA)
        new = spark.createDataFrame([(*key, n) for key, n in changed.items()], SCHEMA).repartition(3)
        got = [tuple(r) for r in incremental_top_n(before, new, ["day", "area"], ["item"], order(), k, "place").collect()]
        touched = {key[:2] for key in changed}
        assert sorted(got, key=str) == ranked(totals, touched, k)
        top = [r for r in top if r[:2] not in touched] + got
    assert sorted(top, key=str) == ranked(totals, {key[:2] for key in totals}, k)


def test_nothing_changed_and_nothing_before(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([("d", "N", "i", 2)], SCHEMA)
    assert incremental_top_n(some, none, ["day", "area"], ["item"], order(), 3, "place").count() == 0
    assert [tuple(r) for r in incremental_top_n(none, some, ["day", "area"], ["item"], order(), 3, "place").collect()] == [("d", "N", "i", 2, 1)]


def test_semi_join_matches_nulls(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([(None,), ("a",), ("a",)], "k string")
    assert sorted(r.v for r in semi(left, right, ["k"]).collect()) == [1, 2]
    assert [r.v for r in semi(left, right, ["k"], keep=False).collect()] == [3]
    assert top_n_per_group(left, ["k"], ["v"], 1).count() == 3
