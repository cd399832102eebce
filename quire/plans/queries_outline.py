"""Registered queries, step 4: outline operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.codecs import md5_text
from quire.operators import blocks as B
from quire.operators import outline as O
from quire.plans import fixtures as X
from quire.plans.queries import query
from quire.session import table


def md_blocks(spark, sf_dir):
    return B.text_blocks(X.markdown_docs(spark, sf_dir), "markdown")


def conversation_blocks(spark, sf_dir):
    """conversations as documents: a level-1 title, then per turn a level-2 heading (the role) and a paragraph."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn").cast("int")
    title = F.struct(F.lit(1).alias("block_no"), F.lit("heading").alias("kind"), F.lit(1).alias("level"),
                     F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("text"))
    head = F.struct((t * 2 + 2).alias("block_no"), F.lit("heading").alias("kind"), F.lit(2).alias("level"),
                    F.col("role").alias("text"))
    para = F.struct((t * 2 + 3).alias("block_no"), F.lit("para").alias("kind"), F.lit(0).alias("level"),
                    F.col("text").alias("text"))
    arr = F.when(F.col("turn") == 0, F.array(title, head, para)).otherwise(F.array(head, para))
    return c.select(F.col("conv_id").alias("doc_id"), F.inline(arr))


@query
def shift_headings(spark, sf_dir):
    return O.shift_headings(md_blocks(spark, sf_dir), 6).select("doc_id", "block_no", "kind", "level")


@query
def number_sections(spark, sf_dir):
    return O.number_sections(md_blocks(spark, sf_dir), offset=1)


@query
def header_ids(spark, sf_dir):
    return O.header_ids(conversation_blocks(spark, sf_dir), prefix="c-").select("doc_id", "block_no", "id")


@query
def toc(spark, sf_dir):
    return O.toc(md_blocks(spark, sf_dir), depth=2)


@query
def split_sections(spark, sf_dir):
    s = O.split_sections(md_blocks(spark, sf_dir), level=2)
    return s.select("doc_id", "section_no", "unit", "title", "n_blocks", md5_text(F.col("text")).alias("text_md5"))


@query
def split_chapters(spark, sf_dir):
    s = O.split_sections(conversation_blocks(spark, sf_dir), level=2, unit="chapter")
    return s.select("doc_id", "section_no", "unit", "title", "n_blocks", md5_text(F.col("text")).alias("text_md5"))


@query
def concat_documents(spark, sf_dir):
    c = O.concat_documents(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return c.select("conv_id", "n_parts", md5_text(F.col("text")).alias("text_md5"))


def turn_blocks(spark, sf_dir):
    """Each conversation turn as its own document: a role heading, then one paragraph per line."""
    c = table(spark, sf_dir, "conversations")
    head = F.struct(F.lit(1).alias("block_no"), F.lit("heading").alias("kind"), F.lit(2).alias("level"),
                    F.col("role").alias("text"))
    paras = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
        (i + 2).cast("int").alias("block_no"), F.lit("para").alias("kind"), F.lit(0).alias("level"), x.alias("text")))
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"), "conv_id", "turn",
                    F.inline(F.concat(F.array(head), paras)))


def _combined(spark, sf_dir):
    tb = turn_blocks(spark, sf_dir)
    groups = tb.select("doc_id", "conv_id", "turn").distinct()
    return O.concat_blocks(tb.drop("conv_id", "turn"), groups, "conv_id", "turn", file_scope=False)


@query
def concat_blocks(spark, sf_dir):
    return _combined(spark, sf_dir)


@query
def concat_header_ids(spark, sf_dir):
    return O.header_ids(_combined(spark, sf_dir)).select("doc_id", "block_no", "id")


@query
def concat_file_scope(spark, sf_dir):
    """O6 with file_scope: conversations put together turn by turn, section numbers and ids of each turn's own."""
    tb = turn_blocks(spark, sf_dir).drop("doc_id").withColumn("doc_id", F.struct("conv_id", "turn"))
    second = tb.where("kind = 'para'").withColumns({"block_no": F.col("block_no") + 1_000_000, "kind": F.lit("heading"), "level": F.lit(3)})
    groups = tb.select("doc_id", "conv_id", "turn").distinct()
    both = O.concat_blocks(tb.unionByName(second).drop("conv_id", "turn"), groups, "conv_id", "turn", file_scope=True)
    ids = O.header_ids(both, by=O.PARTS).select("doc_id", "part", "block_no", "id")
    numbers = O.number_sections(both, by=O.PARTS).select("doc_id", "part", "block_no", "number")
    return ids.join(numbers, ["doc_id", "part", "block_no"]).select(
        "doc_id", "part", F.col("block_no").cast("bigint").alias("block_no"), "id", "number")
