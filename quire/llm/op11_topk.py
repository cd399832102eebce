"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation over inverted lists.

A vector is a sparse row: its terms are the positions of its components other than 0, its weights those components. The
candidates are dealt into blocks by a hash; a block is turned into inverted lists (term -> rows and weights). The queries go
through every block, some at a time: for each term of the queries the list's weights, times the query's, are scattered into
dense score arrays, one array per query. A block's best ``k`` of each query (partition selection) are merged by query.

On Spark a block is one task, whose rows come sorted: first its candidates, then the queries as a stream. In memory are the
lists of one block (``BLOCK`` components at most, the number of blocks follows from a count) and the scores of ``BATCH``
cells. Candidates move once, queries once per block, and each block sends ``k`` rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import read, stored

#: Components of one block, and cells of the score arrays that are filled at a time.
BLOCK, BATCH = 8_000_000, 2_000_000

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Lists:
    """The inverted lists of a block. ``ids``: the ids of its rows, ascending; a row's place is its place in ``ids``."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids, self.largest = ids, _largest(weights)
        order = np.argsort(terms, kind="stable")
        rows, terms, weights = rows[order], terms[order], weights[order]
        ends = np.flatnonzero(np.append(np.diff(terms) != 0, True)) + 1 if len(terms) else np.zeros(0, int)
        self.lists: dict[int, tuple] = {}
        for a, b in zip(np.append(0, ends[:-1]), ends):
            if 2 * (b - a) > len(ids):  # a list of more than half of the rows is kept with the zeros between
                dense = np.zeros(len(ids), weights.dtype)
                dense[rows[a:b]] = weights[a:b]
                self.lists[int(terms[a])] = (None, dense)
            else:
                self.lists[int(terms[a])] = (rows[a:b], weights[a:b])
        self._as: dict[str, dict[int, tuple]] = {}

    def of(self, kind: str) -> dict[int, tuple]:
        if kind not in self._as:
            self._as[kind] = {t: (r, w.astype(kind)) for t, (r, w) in self.lists.items()}
        return self._as[kind]

    def scores(self, n: int, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Inner products of ``n`` sparse query rows with all rows of the block (queries x rows).

        The narrowest type in which every partial sum is exact: whole numbers below 2^24 in 32-bit floats, below 2^53 in
        64-bit ones, else 64-bit integers; a sum that might pass those raises."""
        longest = int(np.bincount(rows, minlength=1).max()) if len(rows) else 0
        bound = longest * _largest(weights) * self.largest
        if bound >= 1 << 63:
            raise ValueError("an inner product may be larger than a long")
        kind = "float32" if bound < 1 << 24 else "float64" if bound < 1 << 53 else "int64"
        lists, weights = self.of(kind), weights.astype(kind)
        scores = np.zeros((n, len(self.ids)), kind)
        product = np.empty_like(scores)
        order = np.argsort(terms, kind="stable")
        rows, terms, weights = rows[order], terms[order], weights[order]
        ends = np.flatnonzero(np.append(np.diff(terms) != 0, True)) + 1 if len(terms) else np.zeros(0, int)
        for a, b in zip(np.append(0, ends[:-1]), ends):
            at, w = lists.get(int(terms[a]), (None, None))
            if w is None:
                continue
            if at is not None:
                scores[np.ix_(rows[a:b], at)] += np.multiply.outer(weights[a:b], w)
            elif b - a == n:
                np.multiply.outer(weights[a:b], w, out=product)
                scores += product
            else:
                scores[rows[a:b]] += np.multiply.outer(weights[a:b], w, out=product[: b - a])
        return scores


def _largest(weights: np.ndarray) -> int:
    return max(abs(int(weights.max())), abs(int(weights.min()))) if len(weights) else 0


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; of equal scores at the bound, the first places."""
    if len(scores) <= k:
        return np.arange(len(scores))
    bound = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > bound)
    return np.append(above, np.flatnonzero(scores == bound)[: k - len(above)])


def _sparse(vecs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the components other than 0."""
    sizes = np.diff(vecs.offsets.to_numpy())
    flat = vecs.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = flat != 0
    return rows[some], terms[some], flat[some]


def _answers(lists: Lists, ids: np.ndarray, vecs: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BATCH // max(1, len(lists.ids)))
    for s in range(0, len(ids), step):
        asked = ids[s : s + step]
        scores = lists.scores(len(asked), *_sparse(vecs[s : s + step]))
        out: tuple[list, list, list] = ([], [], [])
        starts, ends = np.searchsorted(lists.ids, asked, "left"), np.searchsorted(lists.ids, asked, "right")
        for q, own, past, row in zip(asked, starts, ends, scores):
            if past > own:  # a row is no candidate for itself
                kept = np.append(np.arange(own), np.arange(past, len(row)))
                at = kept[best(row[kept], k)]
            else:
                at = best(row, k)
            out[0].append(np.full(len(at), q))
            out[1].append(lists.ids[at])
            out[2].append(row[at].astype("int64"))
        yield pa.record_batch([np.concatenate(c) for c in out], schema=_OUT)


def top_k(candidates: DataFrame, queries: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """The ``k`` highest inner products of every query: query_id, rank (int, from 1), vec_id, score (long).

    Both tables: (vec_id, vec array<bigint>). Ties go to the smaller vec_id. A vector's missing positions are 0, so lengths
    may differ; an empty vector scores 0. Candidates of the query's own vec_id don't count. Rows without an id or a vector,
    or with a null component, take no part. Rows that repeat in full count once; different vectors of one vec_id are rows
    of their own, and as queries share one list. Other columns are not read. No candidates or no queries: no rows.
    ``blocks`` is at least what the number of components asks for. A product that might pass a long raises."""
    spark = candidates.sparkSession
    whole = lambda df: df.select("vec_id", "vec").where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())).distinct()
    rows, asks = stored(whole(candidates), "vectors"), whole(queries)
    parts = rows.agg(F.sum(F.greatest(F.size("vec"), F.lit(1)).cast("long"))).first()[0] or 0
    n = max(blocks or spark.sparkContext.defaultParallelism, -(-parts // BLOCK), 1)
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n)).cast("int").alias("b"), F.lit(False).alias("asks"), "*")
    sent = asks.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"), F.lit(True).alias("asks"), "*")

    def run(batches):
        at, held, lists = None, [], None

        def indexed():
            if not held:
                return None
            ids = np.concatenate([b.column(2).to_numpy() for b in held])
            return Lists(ids, *_sparse(pa.concat_arrays([b.column(3) for b in held])))

        for batch in batches:
            keys = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(keys)]):
                part = batch.slice(s, e - s)
                if keys[s] // 2 != at:
                    at, held, lists = keys[s] // 2, [], None
                if keys[s] % 2 == 0:
                    held.append(part)
                    continue
                if held:
                    lists, held = indexed(), []
                if lists is not None:
                    yield from _answers(lists, part.column(2).to_numpy(), part.column(3), k)

    found = dealt.unionByName(sent).repartitionById(n, F.col("b")).sortWithinPartitions("b", "asks", "vec_id").mapInArrow(
        run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(vec: Column, scale: float = 64.0) -> Column:
    """Every component x as floor(scale * x), x as double; null for a vector that is null or holds a null or non-finite one."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``embeddings`` rows for every row whose vec_id is divisible by 20."""
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding").select(
        F.col("vec_id").cast("long"), whole_numbers(F.col("embedding")).alias("vec"))
    return top_k(rows, rows.where("vec_id % 20 = 0"), 20)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, place::INT AS rank, vec_id, score FROM r WHERE place <= 20
"""
