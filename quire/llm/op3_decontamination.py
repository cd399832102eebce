"""Benchmark decontamination by winnowing (DataFrame operations only).

Texts and benchmark items are cut into words and hashed; of every window of ``n - k + 1`` consecutive k-grams the smallest
hash (leftmost on ties) is kept with its place. Two texts that share ``n`` words in a row share such a window, and so the
fingerprint chosen from it: no shared span of ``n`` words is missed. Fingerprints of texts and items are joined; each
match fixes an alignment (a diagonal), on which the words of text and item are then compared: all windows of ``n`` equal
words are hit. Items of fewer than ``n`` words are one window; of those lengths, all windows of a text are fingerprints.

The search folds case in all alphabets character by character (``loose``), which can only add candidates; the comparison
folds A to Z alone.

Rows: texts are only shuffled once, for the join with their alignments. The fingerprint table of the items is broadcast
only if it has ``BROADCAST_ROWS`` rows at most (counted first); beyond, both sides are shuffled by fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, let, read, sha256_hex, unused

#: What parts words: every ASCII character but digits and lower-case letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of (long, int, long, int) that may be broadcast: about 40 MB.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Words of a lower-cased text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS, -1), "")


def loose(text: Column) -> Column:
    """Lower case in all alphabets. The capital sigma goes first: it alone has two lower-case forms, and which one it gets
    would depend on the letters around it, so words that are equal but for A to Z could come out unlike."""
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _grams(w: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` word hashes; null if there is none."""
    return F.when(F.size(w) >= size, F.transform(
        F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.lit(size), F.slice(w, i, size))))


def winnowed(w: Column, n: int, k: int) -> Column:
    """Fingerprints (pos, fp) of an array of word hashes; null for fewer than ``n`` words."""
    span = n - k + 1

    def chosen(g: Column) -> Column:
        least = F.transform(F.sequence(F.lit(1), F.size(g) - (span - 1)), lambda j: let(
            F.slice(g, j, span), lambda s: (j + F.array_position(s, F.array_min(s)) - 2).cast("int")))
        return F.transform(F.array_distinct(least), lambda p: F.struct(p.alias("pos"), F.get(g, p).alias("fp")))

    return F.when(F.size(w) >= n, let(_grams(w, k), chosen))


def _whole(w: Column, sizes: list[int]) -> list[Column]:
    """All windows of each of these sizes as fingerprints (for the short items)."""
    return [F.coalesce(F.transform(_grams(w, m), lambda x, i: F.struct(i.alias("pos"), x.alias("fp"))),
                       F.array().cast("array<struct<pos:int,fp:bigint>>")) for m in sizes]


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
                  item_text: str = "text", n: int = 10, k: int = 6) -> DataFrame:
    """Adds n_words, n_hit (long), hit_words (places of the hit words, ascending), items (ids of the items with an
    occurring window, as sorted strings; a null id is left out) and contaminated to every row of ``docs``.

    Columns of these names are replaced; others stay, whatever their names. A null or empty text has no words and is not
    contaminated; rows that repeat get the same values; items that repeat are compared once per id. An empty table on
    either side, or items without words, give no hits.
    """
    added = ["n_words", "n_hit", "hit_words", "items", "contaminated"]
    docs = docs.drop(*[c for c in added if c not in (text, key)])
    keep = [F.col(f"`{c}`") for c in docs.columns]
    (th,) = unused(docs, "_th")
    rows = docs.withColumn(th, F.xxhash64(F.col(text)))

    goods = bench.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("t")).distinct()
    goods = goods.select("item", hashes(words_of(loose(F.col("t")))).alias("loose"),
                         hashes(words_of(ascii_lower(F.col("t")))).alias("w")).where(F.size("w") > 0)
    # at most n - 1 numbers
    sizes = sorted(r[0] for r in goods.where(F.size("w") < n).select(F.size("w")).distinct().collect())

    none = F.array().cast("array<struct<pos:int,fp:bigint>>")
    short = F.when(F.size("loose") < n, F.array(F.struct(
        F.lit(0).alias("pos"), F.xxhash64(F.size("loose"), F.col("loose")).alias("fp")))).otherwise(none)
    marks = goods.select("item", F.inline(F.concat(F.coalesce(winnowed(F.col("loose"), n, k), none), short))).select(
        "item", F.col("pos").alias("item_pos"), "fp")
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)

    prints = let(hashes(words_of(loose(F.col(text)))), lambda w: F.concat(F.coalesce(winnowed(w, n, k), none), *_whole(w, sizes)))
    found = rows.select(F.col(key).alias("key"), F.col(th).alias("th"), F.inline(prints)).join(marks, "fp").select(
        "key", "th", "item", (F.col("pos") - F.col("item_pos")).alias("diag")).distinct()
    found = found.join(goods.select(F.col("item").alias("item2"), "w"), F.col("item").eqNullSafe(F.col("item2"))).groupBy(
        "key", "th").agg(F.collect_list(F.struct("item", "diag", "w")).alias("found"))

    def hits(w: Column, c: Column) -> Column:
        """Places of the text's words in windows that equal the item's on this diagonal."""
        size = F.least(F.size(c["w"]), F.lit(n))
        first, last = F.greatest(c["diag"], F.lit(0)), F.least(F.size(w), c["diag"] + F.size(c["w"])) - size
        at = F.filter(F.sequence(first, last), lambda i: F.slice(w, i + 1, size) == F.slice(c["w"], i - c["diag"] + 1, size))
        return F.when(last >= first, F.flatten(F.transform(at, lambda i: F.sequence(i, i + size - 1)))).otherwise(
            F.array().cast("array<int>"))

    def outcome(w: Column, cands: Column) -> Column:
        return let(F.transform(cands, lambda c: F.struct(c["item"].alias("item"), hits(w, c).alias("at"))), lambda r: F.struct(
            F.sort_array(F.array_distinct(F.flatten(F.transform(r, lambda x: x["at"])))).alias("at"),
            F.sort_array(F.array_distinct(F.transform(F.filter(r, lambda x: (F.size(x["at"]) > 0) & x["item"].isNotNull()),
                                                      lambda x: x["item"]))).alias("items")))

    rows = rows.withColumn("n_words", F.size(words_of(loose(F.col(text)))).cast("long"))
    a, b = rows.alias("a"), found.alias("b")
    joined = a.join(b, F.col(f"a.`{key}`").eqNullSafe(F.col("b.key")) & (F.col(f"a.`{th}`") == F.col("b.th")), "left")
    result = F.when(F.col("b.found").isNotNull(), let(
        hashes(words_of(ascii_lower(F.col(f"a.`{text}`")))), lambda w: outcome(w, F.col("b.found"))))
    empty = F.struct(F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("items"))
    (out,) = unused(docs, "_out")
    joined = joined.select("a.*", F.coalesce(result, empty).alias(out)).drop(th)
    return joined.select(*keep, "n_words", F.size(f"{out}.at").cast("long").alias("n_hit"),
                         F.col(f"{out}.at").alias("hit_words"), F.col(f"{out}.items").alias("items"),
                         (F.size(f"{out}.at") > 0).alias("contaminated"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` against ``benchmark``, windows of ten words."""
    out = contamination(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, w[i:i+9] AS g FROM (
    SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT len(g) AS m FROM g),
x AS (SELECT doc_id, m, i, w[i:i+m-1] AS g FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, s)),
h AS (SELECT doc_id, item_id, m, i FROM x JOIN g USING (g)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list(item ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
