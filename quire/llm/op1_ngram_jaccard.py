"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip).

A document's set is its distinct five-word shingles, as 64-bit hashes. Two documents link when their Jaccard similarity is
0.75 or more; every document gets the smallest id that links lead to. Documents of equal sets are one *node* from the start.

1. Inverted lists. Shingles are dealt to buckets of the hash space, packed (sorted, as differences, in byte planes), and
   counted; only those of two or more nodes go back, with their counts, to the nodes. A node of n shingles that links has an
   overlap of T = ceil(0.75 n) with its partner at least: nodes with fewer shared shingles are done, and what is left,
   the *core*, is a small part of an ordinary corpus.
2. Copies first. Nodes that share one of their smallest hashes are compared with the most central of them (the one with the
   largest part of its set shared, as an original among its copies). These links join large groups of near copies at once,
   with one comparison per member and not one per pair.
3. DivideSkip. Of a pair, the node with the smaller part of its set shared asks: its shared shingles are the rarer ones. Of
   its lists by length, the longest, one less than 0.75 n, are long and the others short; a partner occurs in a short one.
   Its short lists, cut to the members that can reach the overlap by their sizes, are heap-merged, which counts each
   candidate; one whose count falls short of the pair's overlap by more than the long lists could add is dropped, all
   others are probed in the whole set by binary search. Lists whose members are in one group already can tell nothing new and are
   left out, as are members of the asker's group. The lists are searched once: first the best candidate per group is probed, then, groups joined, every
   one that is left. So no link between different groups is missed, and group ids are exact.

Hot shingles (in 1/128 of all documents or more: a bounded number, see ``HOT``) are not counted in one bucket but marked
shared and longest, so that no list of that length is ever gathered. Hash collisions: two of m distinct shingles in the same
comparison collide with probability m * m / 2 ** 65.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import components, read, stored
from quire.llm.wordhash import mix, pieces, words

WORDS = 5
#: A link: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Shingles that a task packs at once, and that a bucket gets on average.
PACKED, BUCKET = 1_000_000, 2_000_000
#: Hot: in 1/HOT of the documents or more. At most HOT * (mean set size) shingles can be; they go to every task.
HOT = 128
#: Hashes of a node that lead it to a central one, members of a block of an inverted list, and the count that stands for hot.
SEEDS, BLOCK, LONGEST = 8, 4096, 1 << 40
#: Rows of one or two longs that may be broadcast: 8 or 16 MB.
BROADCAST_ROWS = 1_000_000

_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The set of each text, in order: sorted distinct hashes of its shingles (of the whole sequence below five words)."""
    found, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for buffer, edges, numbers in pieces(texts, b" "):
        begin, _, h = words(buffer, edges)
        found.append(h)
        docs.append(numbers[np.searchsorted(edges, begin, side="right") - 1])
    h, doc = np.concatenate(found), np.concatenate(docs)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    n = max(len(h) - WORDS + 1, 0)
    with np.errstate(over="ignore"):
        full = np.zeros(n, dtype=np.uint64)
        for k, factor in enumerate(_FACTORS):
            full += h[k : k + n] * factor
        full = mix(full + np.uint64(WORDS))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= WORDS:
                s = np.sort(full[a : b - WORDS + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                part = sum((x * f for x, f in zip(h[a:b], _FACTORS)), np.uint64(b - a))
                yield mix(np.array([part], dtype=np.uint64))
            else:
                yield h[:0]


def _sets(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[tuple[object, np.ndarray]]:
    """Keys and sets of a batch of (key, text), a few megabytes of text at a time."""
    keys, texts, held = [], [], 0
    for k, t in zip(batch.column(0), batch.column(1)):
        keys.append(k.as_py())
        texts.append((t.as_py() or "").encode())
        held += len(texts[-1])
        if held > size:
            yield from zip(keys, shingles(texts))
            keys, texts, held = [], [], 0
    yield from zip(keys, shingles(texts))


def _node(s: np.ndarray) -> int | None:
    """The node of a set: 64 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _facts(batches):
    """Per document: key, node, n. Per block of documents and shingle in many of them: hot, n (of how many)."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("hot", pa.int64())])
    held, size, nodes = [], 0, set()

    def frequent():
        if len(held) < 64:
            return []
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts * HOT >= len(held)
        many &= counts >= 32
        return [{"key": None, "node": None, "n": int(c), "hot": int(v)} for v, c in zip(values[many].view(np.int64), counts[many])]

    for batch in batches:
        rows = []
        for key, s in _sets(batch):
            node = _node(s)
            rows.append({"key": key, "node": node, "n": len(s), "hot": None})
            if node is not None and node not in nodes:
                nodes.add(node)
                held.append(s)
                size += len(s)
            if size > PACKED:
                rows += frequent()
                held, size, nodes = [], 0, set()
        yield pa.RecordBatch.from_pylist(rows, schema)
    yield pa.RecordBatch.from_pylist(frequent(), schema)


def _packs(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The numbers between cuts as byte planes: planes of equal bytes vanish when Spark compresses its shuffle files. A pack costs
    a copy of its bytes and no more, since there are as many as there are blocks of documents times buckets."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    ends = cuts.tolist()
    return pa.array([planes[:, a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())


def _unpacked(packs: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all packs, and how many each has."""
    size = np.dtype(dtype).itemsize
    planes = [np.frombuffer(b, dtype=np.uint8).reshape(size, -1) for b in packs.to_pylist()]
    lengths = np.fromiter((p.shape[1] for p in planes), dtype=np.int64, count=len(planes))
    return np.ascontiguousarray(np.concatenate(planes, axis=1).T).view(dtype).ravel(), lengths


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers begins, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, np.int64)


_PACKS = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("h", "at", "nodes", "sizes")])


def _postings(hot: np.ndarray, buckets: int, hot_buckets: int):
    """Packs (hash, node) postings by bucket: hash ranges first, then, for hot shingles, ranges of nodes."""

    def flush(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        nodes = np.fromiter(held, dtype=np.int64, count=len(held))
        sets = list(held.values())
        sizes = np.array([len(s) for s in sets], dtype=np.uint32)
        at = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        h = np.concatenate(sets)
        kind = np.uint16 if buckets + hot_buckets < 1 << 16 else np.int64
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(kind)
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
            by_node = (((nodes.view(np.uint64) >> np.uint64(32)) * np.uint64(hot_buckets) >> np.uint64(32)) + np.uint64(buckets)).astype(kind)
            bucket = np.where(is_hot, by_node[at], bucket)
        # postings stand by node: dealt to buckets in this order, those of one node lie side by side in each
        order = np.argsort(bucket, kind="stable")
        b, a = bucket[order], at[order]
        new = np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]))
        cuts, used, used_cuts = _cuts(b), a[new], _cuts(b[new])
        local = np.empty(len(h), dtype=np.uint32)
        local[order] = np.cumsum(new) - 1 - np.repeat(used_cuts[:-1], np.diff(cuts))
        order = np.argsort(h)
        order = order[np.argsort(bucket[order], kind="stable")] if len(hot) else order
        h = h[order]
        steps = np.diff(h, prepend=np.uint64(0))
        steps[cuts[:-1]] = h[cuts[:-1]]
        return pa.RecordBatch.from_arrays([
            pa.array(b[cuts[:-1]].astype(np.int32)), _packs(steps, cuts), _packs(local[order], cuts), _packs(nodes[used], used_cuts),
            _packs(sizes[used], used_cuts)], schema=_PACKS)

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for _, s in _sets(batch):
                node = _node(s)
                if node is not None and node not in held:
                    held[node] = s
                    size += len(s)
                if size > PACKED:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return run


_SHARED = pa.schema([("part", pa.int32())] + [(c, pa.binary()) for c in ("h", "node", "size", "count")])


def _shared(buckets: int):
    """Of one bucket's postings, those of shingles in two or more nodes, packed by range of nodes."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        steps, lengths = _unpacked(table.column("h"), np.uint64)
        at, _ = _unpacked(table.column("at"), np.uint32)
        nodes, used = _unpacked(table.column("nodes"), np.int64)
        sizes, _ = _unpacked(table.column("sizes"), np.uint32)
        # sums of a pack's steps: sums of all, less what came before the pack, modulo 2 ** 64
        starts = np.cumsum(lengths) - lengths
        h = np.cumsum(steps, dtype=np.uint64)
        h -= np.repeat(h[starts] - steps[starts], lengths)
        at = at + np.repeat(np.cumsum(used) - used, lengths)
        node, size = nodes[at], sizes[at]
        if bucket < buckets:  # only hashes that come twice are worth the full sort
            order = np.argsort(h)
            s = h[order]
            again = np.zeros(len(s), dtype=bool)
            again[1:] = s[1:] == s[:-1]
            again[:-1] |= again[1:]
            order = order[again]
            h, node, size = h[order], node[order], size[order]
        order = np.lexsort((node, h))
        h, node, size = h[order], node[order], size[order]
        new = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])) if len(h) else np.empty(0, bool)
        h, node, size = h[new], node[new], size[new]
        if bucket < buckets:
            lengths = np.diff(_cuts(h))
            count = np.repeat(lengths, lengths)
            many = count >= 2
            h, node, size, count = h[many], node[many], size[many], count[many]
        else:
            count = np.full(len(h), LONGEST)
        part = ((node.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        h, node, size, count, part = h[order], node[order], size[order], count[order], part[order]
        cuts = _cuts(part)
        return pa.Table.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), *[_packs(x, cuts) for x in (
            h, node, size, count.astype(np.int64))]], schema=_SHARED)

    return run


def _long(n: int) -> int:
    """How many lists of an asker of n shingles are long. Fewer would be right too: more lists to merge, fewer candidates."""
    return -(-PERCENT * n // 100) - 1


def _overlap(n: int, m: int) -> int:
    """The least overlap of linked sets of these sizes."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


_CORE = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("hs", pa.list_(pa.int64())), ("short", pa.list_(pa.int64()))])
_CORE_DDL = "node bigint, n bigint, hs array<bigint>, short array<bigint>"


def _core(table: pa.Table) -> pa.Table:
    """The nodes of one range that share enough: their shared shingles, ascending, and those of their short lists."""
    h, node, size, count = (_unpacked(table.column(c), kind)[0] for c, kind in (
        ("h", np.int64), ("node", np.int64), ("size", np.uint32), ("count", np.int64)))
    order = np.lexsort((h, node))
    h, node, size, count = h[order], node[order], size[order], count[order]
    starts = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node))
    rows = []
    for a, b in zip(starts[:-1], starts[1:]):
        n = int(size[a])
        least = (PERCENT * n + 99) // 100
        if b - a >= least:
            by_length = np.lexsort((h[a:b], count[a:b]))
            rows.append({"node": int(node[a]), "n": n, "hs": h[a:b], "short": np.sort(h[a:b][by_length[: b - a - _long(n)]])})
    return pa.Table.from_pylist(rows, _CORE)


def merged(lists: list[list[int]]) -> list[tuple[int, int]]:
    """Heap-merge of ascending lists: each element with the number of its occurrences, ascending."""
    out, last, count = [], None, 0
    for x in heapq.merge(*lists):
        if x == last:
            count += 1
        else:
            if count:
                out.append((last, count))
            last, count = x, 1
    if count:
        out.append((last, count))
    return out


def probed(xs: np.ndarray, ys: np.ndarray) -> int:
    """How many elements of the shorter ascending list binary search finds in the longer one."""
    if len(xs) > len(ys):
        xs, ys = ys, xs
    if not len(xs):
        return 0
    return int((ys[np.minimum(np.searchsorted(ys, xs), len(ys) - 1)] == xs).sum())


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _linked(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the overlap."""
    pairs = stored(pairs, "pairs")

    @F.arrow_udf("boolean")
    def reach(n: pa.Array, m: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for a, b, x, y in zip(n.to_pylist(), m.to_pylist(), xs, ys):
            both = probed(x.values.to_numpy(), y.values.to_numpy())
            out.append(100 * both >= PERCENT * (a + b - both))
        return pa.array(out, pa.bool_())

    x = core.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hs").alias("ha")).join(_bounded(pairs), "a")
    y = core.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hs").alias("hb")).join(
        _bounded(pairs.select("b").distinct()), "b")  # only the sets that are asked for are shuffled
    sized = x.join(y, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    return sized.where(reach("na", "nb", "ha", "hb")).select("a", "b")


def _central(core: DataFrame) -> DataFrame:
    """Pairs of a node and the most central node that shares one of its smallest hashes."""
    seeds = core.select("node", "n", (F.size("hs") / F.col("n")).alias("central"), F.explode(F.slice("hs", 1, SEEDS)).alias("h"))
    best = seeds.groupBy("h").agg(F.max(F.struct("central", "n", "node")).alias("best"))
    return seeds.join(best, "h").select(F.col("node").alias("a"), F.col("best.node").alias("b")).where("a != b").distinct()


def _lists(core: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The short lists whose members are of different groups: askers (a, na, ma, h) and members (h, node, n, m)."""
    roots = core.join(groups, "node", "left").select(F.coalesce("root", "node").alias("root"), F.explode("hs").alias("h"))
    mixed = roots.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("h")
    nodes = core.withColumn("m", F.size("hs"))
    asked = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"), F.explode("short").alias("h"))
    asked = stored(asked.join(mixed, "h"), "asked")
    members = nodes.select("node", "n", "m", F.explode("hs").alias("h")).join(_bounded(asked.select("h").distinct()), "h")
    return asked, stored(members, "members")


def _candidates(asked: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different groups that may link; best: the one of an asker and other group."""
    groups = _bounded(groups)
    members = members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    asked = asked.join(groups.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").withColumn("ra", F.coalesce("ra", "a"))
    # Members are tried one by one in the join, whose compiled condition most of them fail; in list blocks, so that no list is
    # one task's. Fewer lists than members / BLOCK are longer than a block.
    blocks = F.broadcast(members.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"))
    last = F.coalesce("blocks", F.lit(1)) - 1
    x = asked.join(blocks, "h", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("blocks").alias("x")
    y = members.join(blocks, "h", "left").withColumn("block", F.pmod(F.xxhash64("node"), last + 1)).drop("blocks").alias("y")
    na, ma, n, m = (F.col(c) for c in ("x.na", "x.ma", "y.n", "y.m"))
    able = (F.col("y.root") != F.col("x.ra")) & ((na + n) * PERCENT <= F.least(ma, m) * (100 + PERCENT)) & (
        F.greatest(na, n) * PERCENT <= F.least(na, n) * 100) & (
        (ma * n < m * na) | ((ma * n == m * na) & (F.col("x.a") < F.col("y.node"))))
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.block") == F.col("y.block")) & able).groupBy(
        "x.h", "x.block", "x.a", "x.na").agg(F.sort_array(F.collect_list(F.struct("y.node", "y.root", "y.n"))).alias("members"))
    met = met.select("a", "na", F.expr("members.node").alias("nodes"), F.expr("members.root").alias("roots"),
                     F.expr("members.n").alias("sizes")).repartition("a").sortWithinPartitions("a")

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("best", pa.bool_())])

    def run(batches):
        def answer(a, na, lists, about):
            passed, chosen = [], {}
            for b, count in merged(lists):
                rb, nb = about[b]
                if count + _long(na) < _overlap(na, nb):
                    continue  # the long lists can't add what is missing
                passed.append(b)
                if count > chosen.get(rb, (0, 0))[0]:
                    chosen[rb] = (count, b)
            best = {b for _, b in chosen.values()}
            for b in passed:
                yield {"a": a, "b": b, "best": b in best}

        now, lists, about = None, [], {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is not None and r["a"] != now[0]:
                    out.extend(answer(*now, lists, about))
                    lists, about = [], {}
                now = (r["a"], r["na"])
                lists.append(r["nodes"])
                about.update(zip(r["nodes"], zip(r["roots"], r["sizes"])))
            yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist(list(answer(*now, lists, about)), schema)

    return met.mapInArrow(run, "a bigint, b bigint, best boolean").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "best")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes of different groups."""
    groups = _bounded(groups)
    for c in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row its key, n_shingles (set size) and component_id (the smallest key that links lead to).

    ``key``: a whole number. Other columns are not read. A null or empty text, or one without words, has the empty set, links
    with nothing and is its own component. Rows that repeat come as often as they are; a null key takes part in links and
    gets the smallest key of its component, null if there is none. An empty table gives an empty one.
    """
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    facts = stored(docs.mapInArrow(_facts, "key bigint, node bigint, n bigint, hot bigint"), "facts")
    rows = facts.where("hot is null").select("key", "node", "n")
    total, n_docs = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = facts.where("hot is not null").groupBy("hot").agg(F.sum("n").alias("c")).where(F.col("c") * HOT >= n_docs).collect()
    hot_buckets = max(64, -(-sum(r.c for r in hot) // BUCKET))
    hot = np.sort(np.array([r.hot for r in hot], dtype=np.int64).view(np.uint64))
    buckets = max(64, -(-total // BUCKET))

    packs = docs.mapInArrow(_postings(hot, buckets, hot_buckets), "bucket int, h binary, at binary, nodes binary, sizes binary")
    shared = packs.groupBy("bucket").applyInArrow(_shared(buckets), "part int, h binary, node binary, size binary, count binary")
    core = stored(shared.groupBy("part").applyInArrow(_core, _CORE_DDL), "core")

    links = stored(_linked(_central(core), core), "links")
    groups = components(links)
    # what the lists tell of a pair stays as it is when groups are joined, so they are searched once
    found = stored(_candidates(*_lists(core, groups), groups), "candidates")
    for pairs in (found.where("best").select("a", "b"), found.where("not best")):
        links = stored(links.unionByName(_linked(_apart(pairs, groups), core)), "links")
        groups = components(links)

    rows = rows.join(groups, "node", "left").select(
        "key", "node", "n", F.coalesce("root", "node").alias("root"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("key").alias("least"))
    return rows.join(least, "root", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, whole texts."""
    return similar_groups(read(spark, sf_dir, "documents", "doc_id", "text"))
