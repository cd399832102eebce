"""Run the conversion job on a cluster: ``spark-submit quire/__main__.py convert ...`` or ``python -m quire ...``.

convert: requests (JSON lines, one request per line) -> outcome rows (Parquet), one per request, failures included.
stream:  the same over a folder that receives request files (Structured Streaming, availableNow or continuous).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quire.model import JobConfig
from quire.plans.convert import convert_job
from quire.session import apply_cluster_conf, ensure_checkpoint_dir
from quire.sources.fetch import crawl_from_pages
from quire.sources.files import file_table
from quire.sources.requests import read_requests
from quire.streaming.stream import convert_stream, outcome_rows


def _conf(args) -> JobConfig:
    template = None
    if args.document_template:
        with open(args.document_template, encoding="utf-8") as fh:
            template = fh.read()
    return JobConfig(safe_dir=args.safe_dir, safe_dir_mode=args.safe_dir_mode, enable_filter=args.enable_filter,
                     document_template=template)


def _fetch_options(spark: SparkSession, args) -> dict:
    if not args.crawl:
        return {}
    crawl = spark.read.parquet(args.crawl)
    if "page_id" in crawl.columns and "method" not in crawl.columns:  # a pages table: every page fetched with GET
        crawl = crawl_from_pages(crawl)
    return {"http": {"crawl": crawl}}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quire")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("convert", "stream"):
        s = sub.add_parser(name)
        s.add_argument("--requests", required=True, help="file or folder of JSON-lines requests")
        s.add_argument("--out", required=True, help="output folder (Parquet outcome rows)")
        s.add_argument("--crawl", help="Parquet crawl table (url, method, status, body) or pages table")
        s.add_argument("--files", help="root folder of side files for file options")
        s.add_argument("--resources", help="Parquet resource table (md5, content_type, data) for self_contained")
        s.add_argument("--safe-dir", default="/app")
        s.add_argument("--safe-dir-mode", default="strict", choices=("strict", "prefix"))
        s.add_argument("--enable-filter", action="store_true")
        s.add_argument("--document-template", help="template text file for standalone conversions")
        s.add_argument("--no-cluster-conf", action="store_true",
                       help="keep the session's settings instead of quire.session.CLUSTER_CONF")
    sub.choices["stream"].add_argument("--checkpoint", help="stream checkpoint folder (default: under "
                                                           "spark.checkpoint.dir)")
    sub.choices["stream"].add_argument("--interval", help="keep running with this trigger interval (e.g. '10 "
                                                         "seconds'); default: process what is there and stop")
    args = p.parse_args(argv)

    spark = SparkSession.builder.appName("quire").getOrCreate()
    if not args.no_cluster_conf:
        apply_cluster_conf(spark)
    conf = _conf(args)
    options = _fetch_options(spark, args)
    files = file_table(spark, args.files) if args.files else None
    resources = spark.read.parquet(args.resources) if args.resources else None
    if args.cmd == "convert":
        out = convert_job(read_requests(spark, args.requests), conf, options, files=files, resources=resources)
        outcome_rows(out).write.mode("overwrite").parquet(args.out)
    else:
        ckpt = args.checkpoint or ensure_checkpoint_dir(spark).rstrip("/") + "/quire-stream"
        q = convert_stream(spark, args.requests, args.out, ckpt, conf, options, source_format="text",
                           trigger_interval=args.interval, files=files, resources=resources)
        if args.interval:
            q.awaitTermination()


if __name__ == "__main__":
    main()
