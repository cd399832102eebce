"""E3 across restarts: the checkpoint remembers processed files, so a restart redoes nothing and new files are
converted once; every micro-batch writes its own batch folder with overwrite."""

from __future__ import annotations

import base64
import json
import os
import uuid

from quire.session import scratch_path
from quire.streaming.stream import convert_stream


def _request(rid: int, text: str) -> str:
    payload = base64.b64encode(text.encode()).decode()
    return json.dumps({"request_id": rid, "fetcher": {"name": "data", "params": {"data": payload}},
                       "converter": {"from": "markdown", "to": "html"}})


def _write_file(spark, folder: str, rows: list[str]) -> None:
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("append").text(folder)


def test_restart_processes_each_file_once(spark):
    run = scratch_path(spark, f"restart-{uuid.uuid4().hex}")
    src, sink, ckpt = f"{run}/in", f"{run}/out", f"{run}/ckpt"
    _write_file(spark, src, [_request(1, "# One"), _request(2, "# Two")])
    convert_stream(spark, src, sink, ckpt, source_format="text")
    first = sorted((r.request_id, r.code) for r in spark.read.parquet(sink).collect())
    assert first == [(1, 0), (2, 0)]
    batches_before = sorted(os.listdir(sink))

    convert_stream(spark, src, sink, ckpt, source_format="text")  # restart, nothing new
    assert sorted(os.listdir(sink)) == batches_before
    assert sorted((r.request_id, r.code) for r in spark.read.parquet(sink).collect()) == first

    _write_file(spark, src, [_request(3, "# Three")])
    convert_stream(spark, src, sink, ckpt, source_format="text")  # restart with one new file
    got = sorted((r.request_id, r.code) for r in spark.read.parquet(sink).collect())
    assert got == [(1, 0), (2, 0), (3, 0)]
    new_batches = sorted(set(os.listdir(sink)) - set(batches_before))
    assert len([b for b in new_batches if b.startswith("batch_id=")]) == 1


def test_command_line_convert(spark):
    """``python -m quire convert`` on JSON lines with a pages table as crawl (same session)."""
    import quire
    from quire.__main__ import main

    run = scratch_path(spark, f"cli-{uuid.uuid4().hex}")
    lines = [_request(1, "# One"), json.dumps({"request_id": 2, "converter": {"from": "html", "to": "plain"},
                                               "fetcher": {"name": "http", "params": {"url": "http://a/"}}})]
    _write_file(spark, f"{run}/in", lines)
    spark.createDataFrame([(1, "http://a/", "<p>page</p>")], "page_id bigint, url string, html string") \
        .write.parquet(f"{run}/pages")
    main(["convert", "--requests", f"{run}/in", "--out", f"{run}/out", "--crawl", f"{run}/pages", "--no-cluster-conf"])
    got = {r.request_id: r for r in spark.read.parquet(f"{run}/out").collect()}
    assert got[1].code == 0 and bytes(got[1].data) == b"<h1>One</h1>"
    assert got[2].code == 0 and bytes(got[2].data) == b"page"
    assert quire.JobConfig is not None and callable(quire.convert_job)


def test_continuous_trigger(spark):
    run = scratch_path(spark, f"cont-{uuid.uuid4().hex}")
    _write_file(spark, f"{run}/in", [_request(7, "# Seven")])
    q = convert_stream(spark, f"{run}/in", f"{run}/out", f"{run}/ckpt", source_format="text",
                       trigger_interval="1 second")
    try:
        q.processAllAvailable()
        _write_file(spark, f"{run}/in", [_request(8, "# Eight")])
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.request_id for r in spark.read.parquet(f"{run}/out").collect()) == [7, 8]
