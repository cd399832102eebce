"""Sharding by proportional stratified interleaving (DataFrame operations only).

Within each source (stratum) rows are ranked by a seeded hash of their key; the fractional rank ``(2 * rank - 1) /
(2 * rows of the source)`` spreads every source evenly over (0, 1); all rows sorted by it are cut into shards whose row
counts differ by one at most. So each shard, and each long run inside it, has the mixture of the whole.

Both sorts are done bucket by bucket: a source's rows fall into ``BUCKETS`` buckets of the hash, all rows into
``BUCKETS`` buckets of the fractional rank, and the ranks of a bucket start where the counts of the ones before end. So
a source with a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.llm.common import read, text_of, unused

#: Buckets of one sort (16 ** 3, the first three hex digits of the hash): at 3e10 rows, a source with a third of them
#: gives about 2.5 million narrow rows to a window partition, which Spark sorts with spilling.
BUCKETS = 4096


def interleave(df: DataFrame, shards: int, key: str = "doc_id", stratum: str = "source", seed: str = "0") -> DataFrame:
    """Adds ``shard`` (int, 0 to ``shards`` - 1) and ``slot`` (long, gapless from 0 in each shard) to every row.

    Rows keep all their columns; a column named ``shard`` or ``slot`` is replaced, others may have any name. A null
    stratum is a stratum of its own; a null key ranks as the text "null". Rows with equal keys in one stratum are
    ordered by the hash of their other columns; rows that repeat in full are alike, so their order does not matter. An
    empty table gives an empty one. Fewer rows than shards: the first shards get one each.
    """
    df = df.drop("shard", "slot")
    s, h, b, r, n, at, g = unused(df, "_s", "_h", "_b", "_rank", "_rows", "_at", "_g")
    atomic = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    rows = (df.withColumn(s, F.when(F.col(stratum).isNull(), F.lit("")).otherwise(
                F.concat(F.lit("="), F.col(stratum).cast("string"))))
              .withColumn(h, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary")))
              .withColumn(b, F.conv(F.substring(h, 1, 3), 16, 10).cast("int")))
    ties = [F.col(key).asc_nulls_first(), F.xxhash64(*atomic)]

    counts = rows.groupBy(s, b).agg(F.count("*").alias("_c"))
    starts = counts.select(
        F.col(s).alias("_s1"), F.col(b).alias("_b1"),
        (F.sum("_c").over(W.partitionBy(s).orderBy(b)) - F.col("_c")).alias(at),
        F.sum("_c").over(W.partitionBy(s)).alias(n))
    ranked = (rows.join(starts, (F.col(s) == F.col("_s1")) & (F.col(b) == F.col("_b1"))).drop("_s1", "_b1")
                  .withColumn(r, F.col(at) + F.row_number().over(W.partitionBy(s, b).orderBy(h, *ties))).drop(at))
    num = F.col(r) * 2 - 1
    ranked = (ranked.withColumn(g, _div(num * BUCKETS, F.col(n) * 2))
                    .withColumn("_f", num.cast("double") / (F.col(n) * 2).cast("double")))

    # How many ranks fall into each bucket of the fractional rank follows from the counts alone: no second look at rows.
    # One task then sums over at most BUCKETS rows.
    per_bucket = starts.join(counts.select(F.col(s).alias("_s1"), F.col(b).alias("_b1"), "_c"), ["_s1", "_b1"]).select(
        F.inline(_spans(F.col(at), F.col("_c"), F.col(n)))).groupBy("_g1").agg(F.sum("_n").alias("_c"))
    offsets = per_bucket.select("_g1", (F.sum("_c").over(W.orderBy("_g1")) - F.col("_c")).alias(at),
                                F.sum("_c").over(W.partitionBy(F.lit(0))).alias("_all"))
    pos = F.col(at) + F.row_number().over(W.partitionBy(g).orderBy("_f", s, h, *ties)) - 1
    placed = ranked.join(offsets, F.col(g) == F.col("_g1")).withColumn("_pos", pos)
    shard = _div(F.col("_pos") * shards, F.col("_all")).cast("int")
    first = _div(shard.cast("long") * F.col("_all") + shards - 1, F.lit(shards))  # the shard's first position
    return placed.withColumns({"shard": shard, "slot": F.col("_pos") - first}).select(
        *[F.col(f"`{c}`") for c in df.columns], "shard", "slot")


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient of longs."""
    return F.call_function("div", a, b)


def _spans(at: Column, c: Column, n: Column) -> Column:
    """For the ranks at + 1 to at + c of a source of n rows: the buckets of the fractional rank and how many in each."""
    bucket = lambda r: _div((r * 2 - 1) * BUCKETS, n * 2)
    lowest = lambda g: _div(n * g * 2 + BUCKETS * 3 - 1, F.lit(2 * BUCKETS))  # noqa: E731  smallest rank in g or above
    one, last = bucket(at + 1), bucket(at + c)
    few = F.transform(F.sequence(at + 1, at + c), lambda r: F.struct(bucket(r).alias("_g1"), F.lit(1).cast("long").alias("_n")))
    many = F.transform(F.sequence(one, last), lambda g: F.struct(
        g.alias("_g1"), F.greatest(F.least(at + c, lowest(g + 1) - 1) - F.greatest(at + 1, lowest(g)) + 1, F.lit(0)).alias("_n")))
    return F.when(c <= last - one + 1, few).otherwise(many)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards under the law ``rows``; a null text counts 8 bytes and the checksum of no bytes."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        "doc_id", "source",
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"))
    return interleave(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 of a blob's hex digits by the table method; the table is derived from the polynomial 0xEDB88320.
SQL = """
WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i::UBIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
d AS (SELECT doc_id, source, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT d.*, xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(
      range(1, strlen(t) + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::UBIGINT),
      lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255)::BIGINT + 1])))::BIGINT AS text_crc32 FROM d, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS rn,
        count(*) OVER (PARTITION BY source) AS n, md5('0:' || doc_id) AS h FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rn - 1)::DOUBLE / (2 * n)::DOUBLE,
        coalesce('=' || source, ''), h, doc_id) - 1 AS pos, count(*) OVER () AS total FROM r),
q AS (SELECT *, (pos * 24) // total AS shard FROM p)
SELECT doc_id, (strlen(t) + 8)::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard,
  (pos - (shard * total + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM q
"""
