"""Property tests: built-in Spark expressions against brute-force Python models."""
import math
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from visitlens.functions.text import java_split
from visitlens.operators.city_ratio import city_ratio

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def java_split_model(s, sep=","):
    if s is None:
        return None
    if s == "":
        return [""]
    parts = s.split(sep)
    while parts and parts[-1] == "":
        parts.pop()
    return parts


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.text(alphabet=",1a ", max_size=8)), min_size=1, max_size=40))
def test_java_split_matches_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(java_split("s")).collect()]
    assert got == [java_split_model(v) for v in values]


def ratio_model(cities):
    """The summary text computed the way the original aggregate function evaluated it."""
    counts = Counter(cities)
    total = sum(counts.values())
    info = [(name, math.floor(c / total * 1000 + 0.5) / 10, c) for name, c in counts.items()]
    info.sort(key=lambda t: (-t[2], t[0]))
    top = info[:2]
    parts = [f"{n}:{r}%" for n, r, _ in top]
    if len(info) > 2:
        other = 100.0
        for _, r, _ in top:
            other -= r
        parts.append(f"其他:{math.floor(other * 10 + 0.5) / 10}%")
    return total, ",".join(parts)


@SETTINGS
@given(st.lists(st.lists(st.sampled_from(["A", "B", "C", "D", "E_1"]), min_size=1, max_size=60),
                min_size=1, max_size=12))
def test_city_ratio_matches_model(spark, groups):
    rows = [("X", pid, c) for pid, cities in enumerate(groups) for c in cities]
    df = spark.createDataFrame(rows, "area string, click_product_id long, city_name string")
    got = {r.click_product_id: (r.clickcount, r.city_remark)
           for r in city_ratio(df, ["area", "click_product_id"]).collect()}
    assert got == {pid: ratio_model(cities) for pid, cities in enumerate(groups)}
