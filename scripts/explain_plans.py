"""Print the physical plan of registered queries and a one-line summary of
what matters at scale: scans with their pushed filters and read schema,
shuffles, broadcasts, join strategies, windows and Python operators.

usage: python scripts/explain_plans.py [sf_dir] [name-prefix ...] [--full]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tally.plans.catalog import load_all  # noqa: E402
from tally.session import local_session  # noqa: E402

KINDS = ["FileScan parquet", "Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin",
         "BroadcastNestedLoopJoin", "ShuffledHashJoin", "Window", "TakeOrderedAndProject",
         "ObjectHashAggregate", "SortAggregate", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"]


def main() -> None:
    args = [a for a in sys.argv[1:] if a != "--full"]
    full = "--full" in sys.argv
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    spark = local_session(8, 8)
    reg = load_all()
    for name, r in reg.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        plan = r.raw(spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(rf"\b{re.escape(k)}\b", plan)) for k in KINDS}
        summary = ", ".join(f"{k}={v}" for k, v in counts.items() if v)
        print(f"== {name}: {summary}")
        if full:
            r.raw(spark, sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
