"""Write docs/PLANS.md: the executed (AQE final) physical plans of the headline queries.

``python tools/dump_plans.py [sf_dir]`` (default /root/testdata/sf0.1). Each query is run
once, then its plan is printed, so AQE's runtime choices (broadcast conversions, coalesced
shuffle reads) are the ones shown.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from visitlens.plans.registry import QUERIES  # noqa: E402
from visitlens.session import get_session  # noqa: E402

HEADLINE = ["category_top10", "category_session_top10", "area_product_top3",
            "area_product_top3_lineitem", "blacklist_users", "area_city_ads_count", "area_top3_ads"]


def _stream_plan(spark) -> list[str]:
    """Last micro-batch plan of the streaming job, replayed over the sf0.01 click log."""
    from visitlens.session import shared_dir
    from visitlens.sources import adapters as A
    from visitlens.streaming import app
    from visitlens.streaming.registry import read_batches, write_batches
    root = shared_dir(spark, "plans-stream")
    write_batches(A.ads_log(spark, "/root/testdata/sf0.01"), f"{root}/src")
    q = app.start(read_batches(spark, f"{root}/src"), f"{root}/sink", f"{root}/ck", threshold=2, trigger={"availableNow": True},
                  state_partitions=8)
    q.awaitTermination()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        q.explain()
    return ["## streaming job (last micro-batch, changed totals)", "", "```",
            buf.getvalue().rstrip(), "```", ""]


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 8)
    out = ["# Executed physical plans", "",
           f"Generated by `tools/dump_plans.py` on `{sf_dir}` (`local[8]`, 8 shuffle partitions, AQE on).",
           "Each query was run once first, so these are AQE's final plans.", ""]
    for name in HEADLINE:
        df = QUERIES[name](spark, sf_dir)
        for _ in df.toLocalIterator():  # runs this very plan, holding one partition at a time
            pass
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        text = buf.getvalue().split("+- == Initial Plan ==")[0].rstrip()
        out += [f"## `{name}`", "", "```", text, "```", ""]
    out += _stream_plan(spark)
    with open(os.path.join(ROOT, "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")


if __name__ == "__main__":
    main(sys.argv)
