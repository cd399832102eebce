"""Conversion requests, one JSON object per line, parsed without losing malformed rows.

A malformed body is kept with its raw text and flagged (``bad_json``) so its outcome row can still be produced.
A body that is the JSON literal ``null`` decodes to all fields missing (then fails on the missing converter).
Unknown keys are ignored; keys are matched exactly (lower case).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.model import REQUEST_SCHEMA

_PARSE_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def compute_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add costly columns so that each is evaluated once per row.

    The columns come out of a one-element generator. Later filters (validation rules, routing by fetcher) are pushed
    down by Catalyst only to the generator's output, so they reference the computed value instead of inlining the
    whole expression (a JSON parse of a large body) once per reference."""
    s = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select("*", F.inline(F.array(s)))


def parse_requests(raw: DataFrame, body: str = "body") -> DataFrame:
    """``raw(request_id, body)`` -> ``requests(request_id, body, bad_json, fetcher, converter, template)``."""
    b = F.col(body)
    parsed = F.from_json(b, REQUEST_SCHEMA, _PARSE_OPTS)
    null_body = F.trim(b) == "null"
    bad = (
        b.isNull() | (F.trim(b) == "")
        | (~null_body & (F.col("p__").isNull() | F.col("p__._corrupt_record").isNotNull()))
    )
    keep = [c for c in raw.columns if c != body]
    return (
        compute_once(raw.select(*keep, b.alias("body")), p__=parsed)
        .withColumn("bad_json", bad)
        .select(
            *keep, "body", "bad_json",
            F.when(~F.col("bad_json"), F.col("p__.fetcher")).alias("fetcher"),
            F.when(~F.col("bad_json"), F.col("p__.converter")).alias("converter"),
            F.when(~F.col("bad_json"), F.coalesce(F.col("p__.template"), F.lit(""))).otherwise(F.lit(""))
            .alias("template"),
        )
    )


def with_ids(lines: DataFrame) -> DataFrame:
    rid = F.get_json_object("value", "$.request_id").try_cast("bigint")
    fallback = F.xxhash64(F.input_file_name(), F.col("value"))
    return lines.select(F.coalesce(rid, fallback).alias("request_id"), F.col("value").alias("body"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A file or directory of JSON lines. ``request_id`` comes from the body when present, else a hash of file
    and line text (stable across task retries; identical lines of one file share it). An id that is not a whole number
    counts as missing. Rows that share an id are converted one by one all the same."""
    return parse_requests(with_ids(spark.read.text(path)))


def read_requests_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same rows from a directory that receives new files (Structured Streaming file source)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_requests(with_ids(reader.load(path)))
