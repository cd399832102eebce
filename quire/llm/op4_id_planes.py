"""Token ids in files of bit-plane shuffled blocks.

Documents are sorted by id over range partitions; each partition encodes its texts and cuts the stream of ids, an end id
after each document, into blocks of ``BLOCK`` ids. A block of 32-bit ids is transposed into its four byte planes (all
lowest bytes, then all second ones, ...), and each plane is compressed by zstandard. The high planes of a vocabulary are
nearly constant and vanish; the low ones compress better than mixed bytes.

A dataset is a folder of two tables that Spark commits, so that a lost task leaves no half file and any store that Spark
writes will do:

- ``blocks``: one row per block: part, block, first (place of its first id in the part), n_ids, n_bytes per plane and the
  planes, stored without further compression. The rows without the planes are the chunk index;
- ``index``: one row per document: part, ordinal, key, start (place in the part), n_tokens.

Reading gives back each document's ids; ``start`` over the whole dataset adds the sizes of the parts before, of which
there are as many as files. A block is one row in memory at a time, whatever the length of a document.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import read, shared_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK = 65_536
#: Words kept per generation and worker, and the longest one kept (characters).
CACHED, CACHED_CHARS = 300_000, 48
#: Characters that the normaliser only lower-cases, and among which its pattern and this module's agree.
PLAIN = "[\t\n\r\x20-\x7e¡-ɏ]*"


def _plain_pattern(pattern: str) -> re.Pattern | None:
    """A pattern with ``\\p{L}`` and ``\\p{N}`` for lower-cased plain texts, in the standard library's terms, which finds its
    matches two to three times as fast; None if the pattern names other classes."""
    after = {c for k in range(0x250) for c in chr(k).lower()}
    of = lambda kind: "".join(re.escape(c) for c in sorted(after) if unicodedata.category(c)[0] == kind)
    named = pattern.replace(r"\p{L}", of("L")).replace(r"\p{N}", of("N"))
    return None if r"\p" in named else re.compile(named)


class _Words(dict):
    """Lower-case words to their ids as bytes; computes what it doesn't hold."""

    def __init__(self, encode):
        super().__init__()
        self.encode_, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode_(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Encoder:
    """The tokenizers library's encoder, asked once for each recent word of plain texts.

    The file's pipeline normalises, takes the matches of one pattern and encodes each on its own. In texts of ``PLAIN``
    characters its normaliser amounts to lower case, so the matches can be looked up; other texts go to the library whole,
    texts that hold one of the file's special strings too, and so does every file whose pipeline is another one. A special
    string is its id, as the library has it, unless ``special_as_text`` says that it is ordinary text."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        by_word = norm == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in split] == ["Split", "ByteLevel"] and (
            split[0].get("behavior") == "Removed" and split[0].get("invert"))
        pattern = _plain_pattern(split[0]["pattern"]["Regex"]) if by_word else None
        self.findall = pattern and pattern.findall
        added = [t for t in spec.get("added_tokens", []) if not (special_as_text and t.get("special"))]
        self.plain = regex.compile(PLAIN).fullmatch
        self.marks = [t["content"] for t in added if not t.get("normalized")]
        self.low_marks = [t["content"].lower() for t in added if t.get("normalized")]  # looked for in the normalised text
        self.words = _Words(self.whole)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.findall is None or not self.plain(text) or any(m in text for m in self.marks):
            return self.whole(text)
        low = text.lower()
        if any(m in low for m in self.low_marks):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, self.findall(low)))


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path, special_as_text)


def planes(ids: bytes, level: int = 3) -> list[bytes]:
    """The four compressed byte planes of a block of ids."""
    cells = np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4)
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(np.ascontiguousarray(cells[:, k]).tobytes()) for k in range(4)]


def unplanes(parts: list[bytes], n: int) -> bytes:
    """The block of ``n`` ids that ``planes`` split."""
    cells = np.empty((n, 4), dtype=np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    for k, p in enumerate(parts):
        cells[:, k] = np.frombuffer(unpack(p, max_output_size=max(n, 1)), dtype=np.uint8)
    return cells.tobytes()


_ROWS = pa.schema([("part", pa.int32()), ("ordinal", pa.int64()), ("key", pa.int64()), ("start", pa.int64()),
                   ("n_tokens", pa.int64()), ("block", pa.int64()), ("planes", pa.list_(pa.binary()))])
_DDL = "part int, ordinal bigint, key bigint, start bigint, n_tokens bigint, block bigint, planes array<binary>"


def write_ids(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
              end_id: int = END_ID, block: int = BLOCK, special_as_text: bool = False) -> None:
    """Writes every row's ids, ascending by ``key`` (nulls first, ties by text), as a dataset at ``path``.

    ``key``: a whole number; a null or empty text has the end id alone; rows that repeat are written as often as they
    come; an empty table gives an empty dataset. Other columns are not read. ``special_as_text``: see ``Encoder``."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches):
        part, encode = TaskContext.get().partitionId(), encoder(vocabulary, special_as_text).encode
        end, size = np.array([end_id], dtype="<u4").tobytes(), block * 4
        held, at, ordinal, n_block = bytearray(), 0, 0, 0

        def blocks(last: bool):
            nonlocal n_block
            while len(held) >= size or (last and held):
                cut = bytes(held[:size])
                del held[:size]
                yield {"part": part, "ordinal": None, "key": None, "start": n_block * block,
                       "n_tokens": len(cut) // 4, "block": n_block, "planes": planes(cut)}
                n_block += 1

        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0), batch.column(1)):
                ids = encode(t.as_py() or "") + end
                rows.append({"part": part, "ordinal": ordinal, "key": k.as_py(), "start": at, "n_tokens": len(ids) // 4,
                             "block": None, "planes": None})
                at, ordinal = at + len(ids) // 4, ordinal + 1
                held.extend(ids)
                rows.extend(blocks(False))
            yield pa.RecordBatch.from_pylist(rows, _ROWS)
        if held:
            yield pa.RecordBatch.from_pylist(list(blocks(True)), _ROWS)

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(
        F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first())
    made = rows.mapInArrow(run, _DDL).withColumn("kind", F.when(F.col("block").isNull(), "index").otherwise("blocks"))
    made.write.partitionBy("kind").option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The dataset read back: key, ordinal, part, start (over the whole dataset), n_tokens, ids (binary, 32-bit)."""
    rows = spark.read.schema(_DDL + ", kind string").parquet(path)
    index = rows.where("kind = 'index'").select("part", "ordinal", "key", "start", "n_tokens")
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("before"))  # a row per file

    # a part's documents and blocks meet in one task, in the order of their places, a block just before what it covers
    both = rows.select("part", "ordinal", "key", "start", "n_tokens", "block", "planes").repartition("part")
    both = both.sortWithinPartitions("part", "start", F.col("block").asc_nulls_last(), "ordinal")

    def run(batches):
        part, held, base, waiting = None, bytearray(), 0, []  # held: ids from place base on

        def ready():
            nonlocal base
            out = []
            while waiting and waiting[0][3] + waiting[0][4] <= base + len(held) // 4:
                p, o, k, s, n = waiting.pop(0)
                out.append({"part": p, "ordinal": o, "key": k, "start": s, "n_tokens": n,
                            "ids": bytes(held[(s - base) * 4 : (s - base + n) * 4])})
            if out and out[-1]["start"] + out[-1]["n_tokens"] - base > BLOCK:  # what later documents don't need goes
                keep = out[-1]["start"] + out[-1]["n_tokens"]
                del held[: (keep - base) * 4]
                base = keep
            return out

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, held, base, waiting = r["part"], bytearray(), 0, []
                if r["block"] is not None:
                    held.extend(unplanes(r["planes"], r["n_tokens"]))
                else:
                    waiting.append((r["part"], r["ordinal"], r["key"], r["start"], r["n_tokens"]))
                if r["block"] is not None or len(waiting) == 1:
                    out += ready()
            if out:
                yield pa.RecordBatch.from_pylist(out, _OUT)

    found = both.mapInArrow(run, "part int, ordinal bigint, key bigint, start bigint, n_tokens bigint, ids binary")
    return found.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


_OUT = pa.schema([("part", pa.int32()), ("ordinal", pa.int64()), ("key", pa.int64()), ("start", pa.int64()),
                  ("n_tokens", pa.int64()), ("ids", pa.binary())])


def op4_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` written as one dataset in the shared folder; what is returned is read back from it."""
    path = shared_path(spark, "ids")
    write_ids(read(spark, sf_dir, "documents", "doc_id", "text"), path)
    return read_ids(spark, path).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
