"""Byte-level BPE encoding and decoding with a rank queue of hierarchical bitmaps.

A text is split by the vocabulary's pattern; the bytes of each match are merged, lowest rank first and leftmost among
equal ranks. The queue keeps, for every merge rank, a bucket of the linked-list positions whose pair has that rank; a bitmap
of two levels marks the ranks with a bucket, and find-first-set picks the next one. A merge only pushes the two pairs it
creates and leaves their old entries behind: an entry whose position has another pair by now is stale and skipped. So n
bytes take O(n) pushes, whatever the length of a match.

One queue serves all new matches of some megabytes of text: their lists lie side by side, a bucket holds the positions of
all of them, and is worked off at once by array operations. Within a match that is the same as one merge after another as
long as no merge creates a pair of a lower rank than its own; a match where one does is merged again on its own.

Runs as Arrow UDFs on whole columns: the other columns never leave the JVM, and a lost executor's rows are simply encoded
again. Each Python worker numbers the matches it has met, with their ids side by side in one array, so that a text's ids
are one gather; beyond ``CACHED`` matches or ``CACHED_CHARS`` characters it forgets those that came once lately.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import read, sha256_hex, text_of, unused

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Matches that a worker remembers, and their characters: about 100 MB.
CACHED, CACHED_CHARS = 500_000, 20_000_000
#: Characters of text whose new matches are merged by one queue, and matches gathered at once.
TOGETHER, GATHERED = 16_000_000, 250_000


class RankQueue:
    """Buckets of positions by merge rank; two levels of bitmaps mark the ranks that have one."""

    def __init__(self):
        self.buckets: dict[int, list] = {}
        self.low: dict[int, int] = {}  # rank // 256: bits of its ranks with a bucket
        self.top = 0  # bits of the keys of low

    def push(self, rank: int, entry) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(entry)
            return
        self.buckets[rank] = [entry]
        high = rank >> 8
        self.low[high] = self.low.get(high, 0) | 1 << (rank & 255)
        self.top |= 1 << high

    def pop(self) -> tuple[int, list]:
        """The lowest rank with a bucket (find-first-set on both levels), and the bucket."""
        high = (self.top & -self.top).bit_length() - 1
        bits = self.low[high]
        bit = bits & -bits
        if bits == bit:
            del self.low[high]
            self.top ^= 1 << high
        else:
            self.low[high] = bits ^ bit
        rank = high << 8 | bit.bit_length() - 1
        return rank, self.buckets.pop(rank)


def merge(piece: bytes, rank_of) -> list[int]:
    """Ids of one match of the pattern. ``rank_of``: bytes to rank or None; every single byte has a rank."""
    whole = rank_of(piece)
    if whole is not None:
        return [whole]
    n, queue = len(piece), RankQueue()
    end = list(range(1, n + 1))  # linked list: the token at i ends before end[i], where the next one starts
    prev = list(range(-1, n - 1))
    pair = [-1] * n  # rank of the token at i joined with the next

    def renew(i: int, e: int) -> int | None:
        r = rank_of(piece[i:e])
        pair[i] = -1 if r is None else r
        if r is not None:
            queue.push(r, i)
        return r

    for i in range(n - 1):
        renew(i, i + 2)
    while queue.top:
        rank, entries = queue.pop()
        entries.sort()
        for k, i in enumerate(entries):
            if pair[i] != rank:
                continue  # stale
            mid = end[i]
            e = end[i] = end[mid]
            pair[mid] = pair[i] = -1
            new = []
            if e < n:
                prev[e] = i
                new.append(renew(i, end[e]))
            if prev[i] >= 0:
                new.append(renew(prev[i], e))
            if any(r is not None and r < rank for r in new):  # a lower rank came up: the rest of this bucket waits
                for q in entries[k + 1 :]:
                    queue.push(rank, q)
                break
    ids, i = [], 0
    while i < n:
        ids.append(rank_of(piece[i : end[i]]))
        i = end[i]
    return ids


class Pairs:
    """Ranks of joined tokens, for arrays of token ids: a hash table of all pairs that a vocabulary can join."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        left, value = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64)
        slot = self._slot(left)
        while len(left):  # each round, one of the keys that want a free slot gets it; the others go on to the next slot
            free = self.keys[slot] == -1
            self.keys[slot[free]] = left[free]
            placed = self.keys[slot] == left
            self.values[slot[placed]] = value[placed]
            left, value, slot = left[~placed], value[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each a joined with b; -1 for none."""
        keys = a << 32 | b
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        on = np.flatnonzero((found != keys) & (found != -1))
        while len(on):
            slot[on] = (slot[on] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[on]]
            hit = found == keys[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (found != -1)]
        return out


def merge_all(pieces: list[bytes], ranks: dict[bytes, int], pairs: Pairs, byte_ids: np.ndarray) -> list[bytes]:
    """Ids of many matches as 32-bit numbers, by one queue for all of them."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    stop = np.cumsum(length)
    n = len(data)
    token = byte_ids[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # linked lists; n and -1 are ends
    after[stop[length > 0] - 1] = n
    before[(stop - length)[length > 0]] = -1
    pair = np.full(n + 1, -1, dtype=np.int64)  # rank of a position's token joined with the next; -1: none, or no token
    alive = np.ones(n, dtype=bool)
    queue, odd = RankQueue(), set()

    def renew(at: np.ndarray, floor: int) -> None:
        """Pairs of these positions and their next tokens (there is one): their ranks go into the queue."""
        r = pairs.rank(token[at], token[after[at]])
        pair[at] = r
        known = r >= 0
        at, r = at[known], r[known]
        if not len(at):
            return
        if r.min() < floor:
            odd.update(np.searchsorted(stop, at[r < floor], side="right").tolist())
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for rank, part in zip(r[np.append(0, cuts)].tolist(), np.split(at, cuts)):
            queue.push(rank, part)

    renew(np.flatnonzero(after < n), 0)
    while queue.top:
        rank, entries = queue.pop()
        at = np.concatenate(entries) if len(entries) > 1 else entries[0]
        at = np.unique(at[pair[at] == rank])  # the others are stale
        if not len(at):
            continue
        if len(at) > 1:  # of a run of overlapping pairs (as in "aaaa"), every second one from the left
            starts = np.append(True, after[at[:-1]] != at[1:])
            if not starts.all():
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
        mid = after[at]
        e = after[mid]
        right = e < n
        # before the next occurrence is merged, this one's new token stands next to its first token
        near = right & (pair[e] == rank)
        if near.any():
            r = pairs.rank(np.full(int(near.sum()), rank), token[e[near]])
            low = (r >= 0) & (r < rank)
            odd.update(np.searchsorted(stop, at[near][low], side="right").tolist())
        token[at] = rank
        after[at] = e
        before[e[right]] = at[right]
        pair[at] = pair[mid] = -1
        alive[mid] = False
        left = before[at]
        renew(np.unique(np.concatenate([at[right], left[left >= 0]])), rank)
    ids = token[alive].astype(np.int32)
    bounds = np.append(0, np.cumsum(alive)[np.maximum(stop - 1, 0)]) if n else np.zeros(len(pieces) + 1, dtype=np.int64)
    packed = ids.tobytes()
    bounds = (bounds * 4).tolist()
    out = [packed[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    for k in odd:
        out[k] = np.array(merge(pieces[k], ranks.get), dtype=np.int32).tobytes()
    return out


class _Numbers(dict):
    """Matches to their numbers, in the order they are met."""

    def __init__(self, names: list[str]):
        super().__init__((n, k) for k, n in enumerate(names))
        self.names = names

    def __missing__(self, name: str) -> int:
        k = self[name] = len(self.names)
        self.names.append(name)
        return k


class Codec:
    """A rank file of the tiktoken library with its pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.pairs = Pairs(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([k])] for k in range(256)], dtype=np.int64)
        self.numbers = _Numbers([])
        self.pool = np.empty(0, dtype=np.int32)  # ids of all numbered matches
        self.starts = np.zeros(1, dtype=np.int64)  # where each match's ids start, and the end

    def _learn(self) -> None:
        """Merges the matches that have a number but no ids yet."""
        pieces = [p.encode() for p in self.numbers.names[len(self.starts) - 1 :]]
        ids = [self.ranks.get(p) for p in pieces]
        merged = iter(merge_all([p for p, i in zip(pieces, ids) if i is None], self.ranks, self.pairs, self.byte_ids))
        packed = [next(merged) if i is None else i.to_bytes(4, sys.byteorder) for i in ids]
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(packed), dtype=np.int32)])
        ends = self.starts[-1] + np.cumsum(np.fromiter(map(len, packed), dtype=np.int64, count=len(packed))) // 4
        self.starts = np.concatenate([self.starts, ends])

    def _forget(self, used: np.ndarray) -> None:
        """Keeps the matches that come twice or more in ``used``, if there are too many."""
        names = self.numbers.names
        if len(names) <= CACHED and sum(map(len, names)) <= CACHED_CHARS:
            return
        kept = np.flatnonzero(np.bincount(used, minlength=len(names)) > 1)
        if len(kept) > CACHED // 2 or sum(len(names[k]) for k in kept) > CACHED_CHARS // 2:
            kept = kept[:0]
        pool = [self.pool[a:b] for a, b in zip(self.starts[kept], self.starts[kept + 1])]
        self.numbers = _Numbers([names[k] for k in kept])
        self.pool = np.concatenate([self.pool[:0], *pool])
        self.starts = np.append(0, np.cumsum([len(p) for p in pool])).astype(np.int64)

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the texts, in stretches of some texts: the ids, and how many each text has."""
        held, size = [], 0

        def done():
            self._learn()
            lengths, at = np.diff(self.starts), 0
            while at < len(held):
                n, some = 0, []
                while at < len(held) and (not some or n + len(held[at]) <= GATHERED):
                    some.append(held[at])
                    n += len(held[at])
                    at += 1
                which = np.concatenate(some)
                counts = lengths[which]
                ends = np.cumsum(counts)
                total = int(ends[-1]) if len(ends) else 0
                ids = self.pool[np.repeat(self.starts[which] - ends + counts, counts) + np.arange(total)]
                cuts = np.append(0, ends)[np.append(0, np.cumsum([len(x) for x in some]))]
                yield ids, np.diff(cuts)
            if held:
                self._forget(np.concatenate(held))

        for text in texts:
            found = self.findall(text)
            held.append(np.fromiter(map(self.numbers.__getitem__, found), dtype=np.int32, count=len(found)))
            size += len(text)
            if size > TOGETHER:
                yield from done()
                held, size = [], 0
        yield from done()

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    return Codec(path, pattern)


def _encode(texts: pa.Array, path: str, pattern: str) -> pa.ListArray:
    ids, counts = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for some, lengths in codec(path, pattern).encode_all(t.as_py() or "" for t in texts):
        ids.append(some)
        counts.append(lengths)
    offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def _decode(lists: pa.ListArray, path: str, pattern: str) -> pa.Array:
    decode = codec(path, pattern).decode
    return pa.array([decode(x.values.to_pylist()) if x.is_valid else b"" for x in lists], pa.binary())


def bpe_encode(text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The ids of a whole text (array of int; null and empty texts: none). Special tokens are ordinary text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _encode(texts, path, pattern)

    return ids(text)


def bpe_decode(ids: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes that ids stand for (binary; null: none). An id that the vocabulary lacks raises a KeyError."""

    @F.arrow_udf("binary")
    def decoded(lists: pa.Array) -> pa.Array:
        return _decode(lists, path, pattern)

    return decoded(ids)


def bpe_round_trip(text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """(ids, decoded): ``bpe_encode`` and, of its ids, ``bpe_decode``, in one pass over the column. Spark evaluates two UDFs
    of which one takes the other's result side by side, which would encode every text twice."""

    @F.arrow_udf("ids array<int>, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        ids = _encode(texts, path, pattern)
        return pa.StructArray.from_arrays([ids, _decode(ids, path, pattern)], ["ids", "decoded"])

    return both(text)


def encoded(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``ids`` and, decoded from them, ``decoded`` to every row; columns of these names are replaced, all others
    stay, whatever their names. Nulls, repeated rows and empty tables need no care: rows are encoded one by one."""
    (both,) = unused(df, "_both")
    df = df.withColumn(both, bpe_round_trip(F.col(text), path or public_tokenizers.path(VOCABULARY)))
    return df.withColumns({ids: F.col(both)["ids"], out: F.col(both)["decoded"]}).drop(both)


def digests(df: DataFrame) -> DataFrame:
    """n_tokens and the digests of ``ids`` and ``decoded`` in place of these two."""
    return df.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": sha256_hex(F.array_join(F.col("ids").cast("array<string>"), ",")),
        "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded (null: empty)."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return digests(encoded(docs.withColumn("text", text_of())).drop("text"))
