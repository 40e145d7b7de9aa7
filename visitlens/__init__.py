"""visitlens: visit and ad-click analytics as Spark DataFrame / SQL / Structured Streaming jobs.

Batch reports (category top-10, top sessions per category, area product top-3 with a
city-share summary) and streaming reports (click guard / blacklist, running counts per
day-area-city-ad, top-3 ads per day and area), all expressed with built-in Spark
operators so Catalyst plans, prunes and partially aggregates them.
"""

from visitlens.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
