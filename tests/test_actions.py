from visitlens.operators.actions import category_counts, category_events
from visitlens.operators.topk import top_n
from pyspark.sql import functions as F

COLS = "click_category_id long, order_category_ids string, pay_category_ids string"


def _events(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    return sorted((r.kind, r.category_id) for r in category_events(df).collect())


def test_first_match_click_wins(spark):
    assert _events(spark, [(5, "1,2", "3")]) == [("click", "5")]


def test_order_before_pay(spark):
    assert _events(spark, [(-1, "1", "3")]) == [("order", "1")]


def test_only_commas_takes_order_branch(spark):
    assert _events(spark, [(-1, ",", "3")]) == []


def test_repeated_id_counts_twice(spark):
    assert _events(spark, [(-1, "4,4", None)]) == [("order", "4"), ("order", "4")]


def test_zero_and_negative_clicks_count(spark):
    assert _events(spark, [(0, None, None), (-2, None, None)]) == [("click", "-2"), ("click", "0")]


def test_empty_strings_skip_branch(spark):
    assert _events(spark, [(-1, "", "7"), (-1, "", ""), (-1, None, None)]) == [("pay", "7")]


def test_sort_keys_pay_is_not_a_key(spark):
    rows = [(5, None, None)] * 5 + [(-1, "A", None)] + [(-1, None, "A")] * 9
    rows = [(c if c != 5 else 100, o, p) for c, o, p in rows]  # category "100" plays A
    rows = [(r[0], "100" if r[1] else None, "100" if r[2] else None) for r in rows]
    rows += [(200, None, None)] * 5 + [(-1, "200,200", None)]  # B: 5 clicks, 2 orders, 0 pays
    counts = category_counts(spark.createDataFrame(rows, COLS))
    top = top_n(counts, [F.col("click_count").desc(), F.col("order_count").desc(),
                         F.col("category_id").asc()], 10).collect()
    assert [(r.category_id, r.click_count, r.order_count, r.pay_count) for r in top] == [
        ("200", 5, 2, 0), ("100", 5, 1, 9)]
