"""Merkle manifest of a dataset: ternary hash trees by group, kept in van Emde Boas layout.

The rows of a group (a source), in order, are the leaves of its tree; every three consecutive nodes (the last run: fewer,
even one) become the digest of their joined hex digests, until one is left, the group's subroot. The subroots, in the order
of the groups, are the leaves of one more such tree, whose root stands for the whole dataset.

A tree is stored in aligned subtrees (blocks) of ``HEIGHT`` levels of runs. Inside a block the nodes lie in van Emde Boas
order: a tree of so many levels is split at half of them, the upper part comes first, then each lower subtree, all laid out the
same way (``address``). The same arithmetic places nodes when a block is built and finds the siblings of a path when it
is read. The roots of blocks are the leaves of blocks above, until a tree has one block.

On Spark leaves are ranked by a range sort (a group of any size is ranked by many tasks) and offsets from the counts per partition. A
task holds one block. Paths come down from the root, block by block; a leaf's path is put together where its block is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import read, stored

#: Nodes of a run, levels of runs in a block, and the leaves of a block.
ARITY, HEIGHT = 3, 8
LEAVES = ARITY ** HEIGHT
DIGEST = 32


def nodes(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in a van Emde Boas layout of the nodes ``index`` (from the left) at ``depth`` (the root: 0)."""
    index = np.asarray(index, dtype=np.int64)
    at = np.zeros_like(index)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower = levels - upper
        tree, index = np.divmod(index, ARITY ** (depth - upper))
        at += nodes(upper) + tree * nodes(lower)
        levels, depth = lower, depth - upper
    return at


@lru_cache(maxsize=None)
def _addresses(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(ARITY ** depth))


def height(n: int) -> int:
    """Levels of runs above ``n`` leaves."""
    h = 0
    while ARITY ** h < n:
        h += 1
    return h


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _counts(n: int, h: int) -> list[int]:
    """Nodes that are there at depths 0 to ``h``, over ``n`` leaves."""
    return [-(-n // ARITY ** (h - d)) for d in range(h + 1)]


def layout(leaves: list[bytes], h: int) -> bytes:
    """The block over ``leaves``, of ``h`` levels of runs, in van Emde Boas order; places without a node are zeros."""
    out = np.zeros((nodes(h + 1), DIGEST), np.uint8)
    level = [d.hex() for d in leaves]
    for depth in range(h, -1, -1):
        out[_addresses(h + 1, depth)[: len(level)]] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, DIGEST)
        if depth:
            level = [joined(level[i : i + ARITY]) for i in range(0, len(level), ARITY)]
    return out.tobytes()


class Block:
    """A stored block, to read paths from. A path is a list of (siblings before, siblings after) in hex, from the leaf up."""

    def __init__(self, stored_as: bytes, n: int, h: int):
        there = np.frombuffer(stored_as, np.uint8).reshape(-1, DIGEST)
        self.h, self.levels = h, []
        for depth, count in enumerate(_counts(n, h)):
            hexed = there[_addresses(h + 1, depth)[:count]].tobytes().hex()
            self.levels.append([hexed[i : i + 2 * DIGEST] for i in range(0, len(hexed), 2 * DIGEST)])

    def path(self, slot: int) -> list[tuple[str, str]]:
        out = []
        for depth in range(self.h, 0, -1):
            run = slot - slot % ARITY
            level = self.levels[depth]
            out.append(("".join(level[run:slot]), "".join(level[slot + 1 : run + ARITY])))
            slot //= ARITY
        return out


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = hashlib.sha256((before + leaf + after).encode()).hexdigest()
    return leaf


def _packed(path: list[tuple[str, str]]) -> str:
    return ",".join(f"{a}/{b}" for a, b in path)


def _unpacked(text: str) -> list[tuple[str, str]]:
    return [tuple(p.split("/")) for p in text.split(",")] if text else []


# -- on Spark --------------------------------------------------------------------------------------------------------

_BLOCK_DDL = "g string, block bigint, n bigint, total bigint, height int, layout binary, root binary"
_BLOCK = pa.schema([("g", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("height", pa.int32()),
                    ("layout", pa.binary()), ("root", pa.binary())])


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _blocks(rows: DataFrame) -> DataFrame:
    """(g, pos, total, digest) -> the blocks of ``LEAVES`` consecutive leaves of each group."""

    def run(batches):
        def out():
            for (g, block), group in groupby(_rows(batches), lambda r: (r["g"], r["block"])):
                leaves, total = [], 0
                for r in group:
                    leaves.append(r["digest"])
                    total = r["total"]
                h = HEIGHT if total > LEAVES else height(total)
                data = layout(leaves, h)
                yield {"g": g, "block": block, "n": len(leaves), "total": total, "height": h, "layout": data, "root": data[:DIGEST]}

        return _batched(out(), _BLOCK, 32)

    return (rows.select("g", F.expr(f"pos div {LEAVES}").alias("block"), "pos", "total", "digest")
                .repartition("g", "block").sortWithinPartitions("g", "block", "pos").mapInArrow(run, _BLOCK_DDL))


def _placed(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` (with g) and pos, their place in their group by ``order``, and total, the group's leaves; written to the shared
    folder. Rows alike in ``order`` are ordered by where they were read, so copies split over partitions too."""
    rows = stored(leaves.withColumn("_s", F.monotonically_increasing_id()).repartitionByRange("g", *order, "_s").sortWithinPartitions(
        "g", *order, "_s").drop("_s").withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part"), F.col("g").alias("_g")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = counts.select("_part", "_g", "_first", F.sum("_n").over(W.partitionBy("_g")).alias("total"),
                           (F.sum("_n").over(W.partitionBy("_g").orderBy("_part")) - F.col("_n")).alias("_start"))
    return rows.join(starts, (part == F.col("_part")) & F.col("g").eqNullSafe(F.col("_g"))).withColumn(
        "pos", F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_g", "_first", "_start", "_at")


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """The written blocks over placed leaves (g, pos, total, digest), then those over their roots, and so on."""
    out = []
    while True:
        out.append(stored(_blocks(leaves), "blocks"))
        more = out[-1].where(F.col("total") > LEAVES)
        if not more.limit(1).count():
            return out
        leaves = more.select("g", F.col("block").alias("pos"), F.expr(f"(total + {LEAVES - 1}) div {LEAVES}").alias("total"),
                             F.col("root").alias("digest"))


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(g, root) of every group."""
    out = None
    for blocks in levels:
        top = blocks.where(F.col("total") <= LEAVES).select("g", "root")
        out = top if out is None else out.unionByName(top)
    return out


def _paths(rows: DataFrame, blocks: DataFrame, make, schema: pa.Schema, ddl: str) -> DataFrame:
    """``make(row, path above the row's slot, the block's record)`` of every row (g, pos, ...), its block read once and its
    rows as a stream. ``blocks``: with ``path``, that of the block's root."""
    columns = [c for c in rows.columns if c not in ("g", "pos")]
    types = dict(rows.dtypes)
    none = [F.lit(None).cast(types[c]).alias(c) for c in columns]
    both = blocks.select("g", "block", F.lit(-1).cast("bigint").alias("pos"), *none, "n", "height", "layout", "path", "subroot").unionByName(
        rows.select("g", F.expr(f"pos div {LEAVES}").alias("block"), "pos", *columns), allowMissingColumns=True)

    def run(batches):
        def out():
            block, record, above = None, None, None
            for r in _rows(batches):
                if r["pos"] < 0:
                    block, record, above = Block(r["layout"], r["n"], r["height"]), r, _unpacked(r["path"])
                else:
                    yield make(r, block.path(r["pos"] % LEAVES) + above, record)

        return _batched(out(), schema, 5000)

    return both.repartition("g", "block").sortWithinPartitions("g", "block", "pos").mapInArrow(run, ddl)


_UP = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("path", pa.string()), ("subroot", pa.string())])
_UP_DDL = "g string, pos bigint, path string, subroot string"


def _down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest blocks with the path of each block's root. ``tops``: (g, path, subroot) of the groups."""
    def up(r, path, record):
        return {"g": r["g"], "pos": r["pos"], "path": _packed(path), "subroot": record["subroot"]}

    above = None
    for blocks in reversed(levels):
        top = blocks.where(F.col("total") <= LEAVES).join(tops.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
        if above is not None:
            lower = blocks.where(F.col("total") > LEAVES)
            paths = _paths(lower.select("g", F.col("block").alias("pos")), above, up, _UP, _UP_DDL)
            named = paths.select(F.col("g").alias("_g"), F.col("pos").alias("_block"), "path", "subroot")
            top = top.unionByName(lower.join(named, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_block")))
                                  .drop("_g", "_block"))
        above = stored(top, "paths")
    return above


_PROOF = pa.schema([("g", pa.string()), ("key", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()),
                    ("folded_root", pa.string())])
_PROOF_DDL = "g string, key bigint, leaf string, subroot string, proof_sha256 string, folded_root string"


def manifest(leaves: DataFrame) -> tuple[DataFrame, str]:
    """Inclusion proofs of a dataset's rows. ``leaves``: g (string), key (long), digest and now (binary, 32 bytes): the
    group, the order in it, the row's digest when the manifest was made and the one found now.

    Returns (proofs, root): one row per leaf with g, key, leaf (hex of digest), subroot, proof_sha256 (the digest of all
    its siblings from the leaf to the root, left to right) and folded_root (the root from ``now`` and those siblings).

    Null groups and null keys come first; rows of one key go by digest, and rows that repeat are leaves of their own. An
    empty table: no rows, and the digest of nothing as root. A group of one row: its leaf is the subroot."""
    placed = _placed(leaves.select("g", "key", "digest", "now"), "key", "digest")
    levels = _levels(placed.select("g", "pos", "total", "digest"))
    tops = _tops(levels)
    groups = _placed(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest")), "name")
    upper = _levels(groups.select("g", "pos", "total", "digest"))
    found = _tops(upper).first()
    if found is None:
        return placed.sparkSession.createDataFrame([], _PROOF_DDL), joined([])
    root = bytes(found["root"]).hex()

    def up(r, path, record):
        return {"g": r["name"], "pos": r["pos"], "path": _packed(path), "subroot": r["digest"].hex()}

    top = _down(upper, tops.sparkSession.range(1).select(F.lit("").alias("g"), F.lit("").alias("path"), F.lit(root).alias("subroot")))
    per_group = stored(_paths(groups.select("g", "pos", "name", "digest"), top, up, _UP, _UP_DDL).drop("pos"), "groups")

    def proof(r, path, record):
        return {"g": r["g"], "key": r["key"], "leaf": r["digest"].hex(), "subroot": record["subroot"],
                "proof_sha256": joined([a + b for a, b in path]), "folded_root": folded(r["now"].hex(), path)}

    return _paths(placed.select("g", "pos", "key", "digest", "now"), _down(levels, per_group), proof, _PROOF, _PROOF_DDL), root


def leaf_digest(*values: Column) -> Column:
    """sha256 (binary) of the values: ``-`` for null, else their UTF-8 byte count, ``:`` and themselves."""
    field = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[field(v.cast("string")) for v in values]).cast("binary"), 256))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` row's proof; half of the rows are checked after their texts lost their line breaks."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    digest = leaf_digest(*before, F.col("text"))
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & (F.instr("text", "\n") > 0)
    now = F.when(tampered, leaf_digest(*before, F.replace("text", F.lit("\n"), F.lit(""))))
    leaves = docs.select(F.col("source").cast("string").alias("g"), F.col("doc_id").cast("long").alias("key"), digest.alias("digest"),
                         now.alias("now")).withColumn("now", F.coalesce("now", "digest"))
    proofs, root = manifest(leaves)
    return proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
                         (F.col("folded_root") == root).alias("verified"))


#: Nodes of all trees, level by level; then each leaf climbs them.
SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i::UBIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(
      range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::UBIGINT),
      lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255)::BIGINT + 1]))) % 2 AS odd FROM documents, crc),
e AS (SELECT *, replace(text, chr(10), '') AS cut FROM d),
l AS MATERIALIZED (SELECT doc_id, source AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(CASE odd WHEN 0 THEN strlen(cut) || ':' || cut ELSE strlen(text) || ':' || text END, '-')) AS now,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos FROM e),
a(g, lvl, pos, h, n) AS (
  SELECT g, 0, pos, leaf, count(*) OVER (PARTITION BY g) FROM l
  UNION ALL
  SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM a WHERE n > 1 GROUP BY g, lvl, pos // 3),
tops AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
b(lvl, pos, h, n) AS (
  SELECT 0, pos, h, n FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM b WHERE n > 1 GROUP BY lvl, pos // 3),
ar AS MATERIALIZED (SELECT x.g, x.lvl, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS before,
    coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS after
  FROM a x JOIN a y ON x.g IS NOT DISTINCT FROM y.g AND x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY x.g, x.lvl, x.pos),
br AS MATERIALIZED (SELECT x.lvl, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS before,
    coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS after
  FROM b x JOIN b y ON x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY x.lvl, x.pos),
c(doc_id, g, leaf, lvl, pos, h, sib) AS (
  SELECT doc_id, g, leaf, 0, pos, now, '' FROM l
  UNION ALL
  SELECT doc_id, c.g, leaf, c.lvl + 1, c.pos // 3, sha256(before || h || after), sib || before || after
  FROM c JOIN ar ON ar.g IS NOT DISTINCT FROM c.g AND ar.lvl = c.lvl AND ar.pos = c.pos),
last AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1),
u(doc_id, g, leaf, subroot, lvl, pos, h, sib) AS (
  SELECT doc_id, last.g, leaf, tops.h, 0, tops.pos, last.h, sib FROM last JOIN tops ON tops.g IS NOT DISTINCT FROM last.g
  UNION ALL
  SELECT doc_id, u.g, leaf, subroot, u.lvl + 1, u.pos // 3, sha256(before || h || after), sib || before || after
  FROM u JOIN br ON br.lvl = u.lvl AND br.pos = u.pos),
done AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM b WHERE n = 1) AS root, sha256(sib) AS proof_sha256, h AS folded_root,
  h = (SELECT h FROM b WHERE n = 1) AS verified FROM done
"""
