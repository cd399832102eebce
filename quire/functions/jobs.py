"""Corpus jobs built on the codecs (F1-F7). Each takes a DataFrame and returns a DataFrame; none collects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.codecs import (
    ENTITY_RE, ESCAPES, b64_decode, b64_encode, decode_entity, entity_codepoint, html_escape, html_unescape,
    json_html_safe, md5_text, utf8,
)


def encode_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, payload, payload_chars), payload = one-line padded base64 of the UTF-8 text."""
    p = b64_encode(utf8(F.col(text)))
    return docs.select("doc_id", p.alias("payload"), F.length(p).cast("bigint").alias("payload_chars"))


def decode_corpus(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """F2 per row: (doc_id, source, ok, data) with ``data`` NULL for a rejected payload."""
    data = b64_decode(F.col(payload))
    return payloads.select("doc_id", "source", data.isNotNull().alias("ok"), data.alias("data"))


def decode_summary(decoded: DataFrame) -> DataFrame:
    """F2 set result: good / rejected counts and decoded bytes per source."""
    return decoded.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(~F.col("ok"), 1).otherwise(0)).cast("bigint").alias("n_rejected"),
        F.sum(F.coalesce(F.octet_length("data"), F.lit(0))).cast("bigint").alias("decoded_bytes"),
    )


def export_json(df: DataFrame, *cols: str) -> DataFrame:
    """one HTML-safe JSON object per row (value column ``json``); map keys are written in sorted order; write
    with ``.write.text``."""
    from pyspark.sql.types import MapType

    types = {f.name: f.dataType for f in df.schema.fields}
    chosen = []
    for c in cols or df.columns:
        col = F.col(c)
        if isinstance(types.get(c), MapType):
            col = F.map_from_entries(F.array_sort(F.map_entries(col))).alias(c)
        chosen.append(col)
    return df.select(json_html_safe(F.to_json(F.struct(*chosen))).alias("json"))


def duplicate_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """groups of identical texts, keyed by md5 and length; kept id = smallest.

    Partial aggregation runs before the shuffle, so a hot group (a text copied a million times) is pre-counted per
    task and arrives as one small row per task."""
    return (
        docs.select("doc_id", md5_text(F.col(text)).alias("text_md5"), F.length(text).cast("bigint").alias("n_chars"))
        .groupBy("text_md5", "n_chars")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("kept_id"))
        .filter(F.col("n_docs") > 1)
    )


def byte_profile(docs: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """bytes and characters per group (integer sums)."""
    keys = keys or ("lang", "source")
    return docs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.octet_length(text)).cast("bigint").alias("n_bytes"),
        F.sum(F.length(text)).cast("bigint").alias("n_chars"),
    )


def escape_corpus(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """escaped text and the number of characters replaced."""
    chars = "".join(c for c, _ in ESCAPES)
    t = F.col(text)
    return docs.select(
        key, html_escape(t).alias("escaped"),
        (F.length(t) - F.length(F.translate(t, chars, ""))).cast("bigint").alias("n_replaced"),
    )


def entity_inventory(docs: DataFrame, text: str = "text") -> DataFrame:
    """every character reference in the corpus with its count, whether it is known, and its decoding."""
    toks = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(ENTITY_RE), 0)).alias("entity"))
    counted = toks.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "entity", "n", entity_codepoint(F.col("entity")).isNotNull().alias("known"),
        decode_entity(F.col("entity")).alias("decoded"),
    )


def unescape_corpus(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """F7 decode job."""
    return docs.select(key, html_unescape(F.col(text)).alias("decoded"))
