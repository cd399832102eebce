"""Print a compact operator summary of each registered query's physical plan (exchanges, joins, windows, scans)."""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.plans.catalog import QUERIES  # noqa: E402
from quire.session import local_session  # noqa: E402

KINDS = ["Exchange hashpartitioning", "Exchange RoundRobin", "BroadcastExchange", "SortMergeJoin",
         "BroadcastHashJoin", "ShuffledHashJoin", "Window", "HashAggregate", "ObjectHashAggregate",
         "SortAggregate", "Generate", "FileScan", "Union", "EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]
SKIP = {"convert_stream", "write_documents", "fetch_files", "read_requests_stream", "convert_with_files"}


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(QUERIES)
    spark = local_session(cores=os.environ.get("PLAN_CORES", "*"))
    for name in names:
        if name in SKIP:
            continue
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        c = Counter()
        for k in KINDS:
            c[k] = len(re.findall(re.escape(k), plan))
        c["Exchange hashpartitioning"] = len(re.findall(r"Exchange hashpartitioning", plan))
        parts = [f"{k.split()[0] if k.startswith('Exchange') and k != 'Exchange hashpartitioning' else k}={v}"
                 for k, v in c.items() if v]
        print(f"{name:28s} " + " ".join(parts))
    spark.stop()


if __name__ == "__main__":
    main()
