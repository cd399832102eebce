"""The conversion job over an arriving directory of requests (Structured Streaming).

Each micro-batch runs the batch job (E1) unchanged through ``foreachBatch`` and writes its outcomes to
``<sink>/batch_id=<n>`` with overwrite, so a replayed batch (after a driver or executor loss) rewrites the same
folder: together with the checkpointed source offsets the sink is exactly-once. The job is stateless, so no
watermark or state store is involved; windows over exploded blocks are not allowed in plain streaming plans, which
is why the per-batch work goes through ``foreachBatch``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.model import JobConfig
from quire.plans.convert import convert_job
from quire.sources.requests import parse_requests, with_ids

RAW_SCHEMA = "request_id bigint, body string"


def outcome_rows(out: DataFrame) -> DataFrame:
    return out.select(
        "request_id", F.col("code").cast("bigint").alias("code"), F.col("rule").cast("bigint").alias("rule"),
        "message", "template_used", "dst_format", F.col("outcome.result.data").alias("data"), "status",
        "content_type", "response",
    )


def convert_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                   conf: JobConfig = JobConfig(), fetch_options: dict | None = None,
                   max_files_per_trigger: int = 1000, source_format: str = "parquet",
                   trigger_interval: str | None = None, files: DataFrame | None = None,
                   resources: DataFrame | None = None):
    """Start the stream. Without ``trigger_interval`` it processes what is there (``availableNow``), stops, and is
    waited for; with one (e.g. ``"10 seconds"``) it keeps running like the service did and the query handle is
    returned at once (stop it with ``.stop()``).

    ``source_format`` ``parquet`` reads ``(request_id, body)`` files; ``text`` reads JSON lines (S2).
    ``max_files_per_trigger`` bounds a micro-batch, also when the stream starts on a backlog; nothing is left out.
    ``files`` and ``resources`` are the side tables of the batch job."""
    reader = spark.readStream.format(source_format).option("maxFilesPerTrigger", str(max_files_per_trigger))
    if source_format == "parquet":
        raw = reader.schema(RAW_SCHEMA).load(source_dir)
    else:
        raw = with_ids(reader.load(source_dir))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        out = convert_job(parse_requests(batch), conf, fetch_options, files=files, resources=resources)
        outcome_rows(out).write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={batch_id}"))

    writer = raw.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    if trigger_interval:
        return writer.trigger(processingTime=trigger_interval).start()
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q
