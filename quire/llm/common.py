"""Helpers shared by the operators: reading a table, text columns, shared storage, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ensure_checkpoint_dir

#: The white space that separates words in the contracts: the blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table as Parquet; only ``cols`` are scanned when given."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor and the driver can see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here, and each reader prunes its columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(c: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(c), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(c: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order (array of string)."""
    return F.array_remove(F.split(c, r"[\x20\x09-\x0D]+", -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node reached.

    ``edges``: two columns ``a`` and ``b`` of one ordered type. Alternates the large-star and small-star steps, each a
    ``groupBy`` minimum and a join, so a hub with very many neighbours is pre-aggregated and its join can be split. Each
    round is cut with a written table in the shared folder. Nodes without an edge to another node do not appear.
    No edges: no rows. Raises if ``rounds`` rounds do not settle it (they double the reach each time)."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = both.join(low, "a")
        if large:  # each larger neighbour points to the smallest of the neighbourhood
            out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # a > b here: the node and its smaller neighbours point to the smallest
            out = linked.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                low.select("a", F.col("m").alias("b")))
        return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                 "edges")
    seen = state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = stored(star(star(now, True), False), "edges")
        last, seen = seen, state(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
