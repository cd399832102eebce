"""Stage and task times of queries from Spark's event log (written to a fresh scratch folder; no UI).

Usage: python tools/stage_times.py [sf_dir] query [query ...]
Prints per stage: tasks, median / max task milliseconds (max / median shows skew), shuffle read and write MB.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from quire.plans.catalog import QUERIES  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.1"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    log_dir = tempfile.mkdtemp(prefix="quire-eventlog-")
    spark = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName("quire-stages")
             .config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", log_dir).config("spark.eventLog.compress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    marks = []
    for name in args:
        spark.sparkContext.setJobDescription(name)
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        marks.append(name)
    spark.stop()
    tasks = defaultdict(list)
    meta = {}
    job_of_stage, desc_of_job = {}, {}
    for path in sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)):
        with open(path, encoding="utf-8") as fh:
            for line in fh:
                e = json.loads(line)
                ev = e.get("Event")
                if ev == "SparkListenerJobStart":
                    desc_of_job[e["Job ID"]] = (e.get("Properties") or {}).get("spark.job.description", "")
                    for sid in e.get("Stage IDs", []):
                        job_of_stage[sid] = e["Job ID"]
                elif ev == "SparkListenerTaskEnd":
                    m = e.get("Task Metrics") or {}
                    sr = m.get("Shuffle Read Metrics") or {}
                    sw = m.get("Shuffle Write Metrics") or {}
                    tasks[e["Stage ID"]].append((
                        m.get("Executor Run Time", 0),
                        sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0),
                        sw.get("Shuffle Bytes Written", 0)))
                elif ev == "SparkListenerStageCompleted":
                    info = e["Stage Info"]
                    meta[info["Stage ID"]] = info.get("Stage Name", "")
    print(f"{'query':24s} {'stage':>5s} {'tasks':>5s} {'med ms':>7s} {'max ms':>7s} {'skew':>5s} "
          f"{'shr MB':>7s} {'shw MB':>7s}  name")
    for sid in sorted(tasks):
        t = tasks[sid]
        runs = [x[0] for x in t]
        med = statistics.median(runs)
        q = desc_of_job.get(job_of_stage.get(sid), "")
        print(f"{q[:24]:24s} {sid:5d} {len(t):5d} {med:7.0f} {max(runs):7d} {max(runs) / max(med, 1):5.1f} "
              f"{sum(x[1] for x in t) / 1e6:7.1f} {sum(x[2] for x in t) / 1e6:7.1f}  {meta.get(sid, '')[:40]}")
    print(f"event log: {log_dir}")


if __name__ == "__main__":
    main()
