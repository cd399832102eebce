"""Conversation structure repair by weighted CYK interval parsing.

A conversation's turns are the terminals, and a grammar over role initials, ``(s?(ua)+)?``, is what it has to become. Edits
turn rows into that language: Keep (cost 0), Rerole to user or assistant (2), Delete (3; blank and repeated turns must go) and
Insert (2, an empty user or assistant turn, anywhere); a truncated turn that stays costs 1 more. The answer is the edit
sequence of least cost and, of those, with the least string of edit initials.

The grammar, in Chomsky normal form, has a nonterminal ``pq`` for each pair of the marks 0 (start), 1 (after the system
turn), 2 (after a user turn), 3 (after an assistant turn): the rows that lead from p to q. Binary rules are ``pq -> pr rq``
for every r; terminal rules are the edits of one row. Inserted turns derive from no row, so each cell is closed under
insertion before and after (``INSERTED``). A cell of a span holds the least (cost, audit) for each nonterminal, and spans are
combined bottom-up by length: 1, 2, 4 and so on. One split of a span is enough, since the binary rules exist for every mark
between; the tests compare with all splits. Within a nonterminal, audits of one span and cost are never prefixes of one
another (one that went on would insert, and cost more), so the least audit is made of least audits.

On Spark, faults are found on narrow rows (no texts): repeats are joined from a map-side aggregate, and the rows are range
partitioned by conversation and turn, so a conversation of very many turns is parsed in many tasks, a span each; the spans'
cells are combined per conversation. The texts move once, to be put out with the edits of their span, one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import BLANKS, let, read, stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1

#: The role initials that lead from one mark to another.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
MARKS, ENDS = range(4), (0, 3)
LEGAL = ("su", "ua", "au")
#: Initials whose role an edit may give.
ROLES = {"u": "user", "a": "assistant"}

Cell = dict[tuple[int, int], tuple[int, str]]


def better(cell: Cell, at: tuple[int, int], cost: int, audit: str) -> None:
    if at not in cell or (cost, audit) < cell[at]:
        cell[at] = (cost, audit)


def combined(a: Cell, b: Cell) -> Cell:
    """The cell of two spans side by side: the binary rules."""
    out: Cell = {}
    for (p, r), (c, x) in a.items():
        for q in MARKS:
            if (r, q) in b:
                d, y = b[r, q]
                better(out, (p, q), c + d, x + y)
    return out


def _insertions() -> Cell:
    """No row, any inserted turns: the identity, closed under one insertion more."""
    cell: Cell = {(p, p): (0, "") for p in MARKS}
    one = {(p, q): (INSERT_COST, INSERT) for (p, initial), q in MOVES.items() if initial in ROLES}
    for _ in MARKS:
        for at, found in combined(cell, one).items():
            better(cell, at, *found)
    return cell


INSERTED = _insertions()


def row_cell(symbol: str) -> Cell:
    """Terminal rules of one row, closed under insertion. ``symbol``: ``x`` for a row that must go, else its role's initial
    (``o`` for one that no place takes), in upper case for a truncated row."""
    cell: Cell = {(p, p): (DELETE_COST, DELETE) for p in MARKS}
    if symbol != "x":
        initial, more = symbol.lower(), TRUNCATED_COST * symbol.isupper()
        for (p, becomes), q in MOVES.items():
            if becomes == initial:
                better(cell, (p, q), more, KEEP)
            elif becomes in ROLES:
                better(cell, (p, q), REROLE_COST + more, REROLE)
    return combined(combined(INSERTED, cell), INSERTED)


@lru_cache(maxsize=20_000)
def _short(symbols: str) -> Cell:
    if len(symbols) == 1:
        return row_cell(symbols)
    half = 1 << (len(symbols) - 1).bit_length() - 1
    return combined(_short(symbols[:half]), _short(symbols[half:]))


#: Rows of the spans that are remembered, since short sequences of roles recur all over a corpus.
REMEMBERED = 8


def span_cell(symbols: str) -> Cell:
    """The cell of a run of rows, bottom-up over spans of 8, 16, 32 ... rows. No rows: only insertions."""
    cells = [_short(symbols[i : i + REMEMBERED]) for i in range(0, len(symbols), REMEMBERED)] or [INSERTED]
    while len(cells) > 1:
        cells = [combined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def chosen(cells: list[Cell]) -> tuple[int, list[tuple[int, str]]]:
    """Least cost of the spans' cells in a row, and each span's (mark it starts from, audit)."""
    paths = {0: (0, "", [])}
    for cell in cells:
        now: dict[int, tuple] = {}
        for (p, q), (c, x) in cell.items():
            if p in paths:
                cost, audit, parts = paths[p]
                if q not in now or (cost + c, audit + x) < now[q][:2]:
                    now[q] = (cost + c, audit + x, [*parts, (p, x)])
        paths = now
    cost, _, parts = min(paths[q] for q in ENDS if q in paths)
    return cost, parts


# -- on Spark --------------------------------------------------------------------------------------------------------

_SPAN = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("h", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ("min_turn", pa.int64()), ("max_turn", pa.int64()), ("turns", pa.int64()), ("marks", pa.list_(pa.int64())),
    ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
_SPAN_DDL = ("conv_id bigint, turn bigint, h string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, "
             "last string, min_turn bigint, max_turn bigint, turns bigint, marks array<bigint>, costs array<bigint>, audits array<string>")
_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_EDITS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("h", pa.string()), ("mark", pa.int64()), ("edits", pa.string()),
                    *[(c, pa.int64()) for c in _TOTALS]])
_EDITS_DDL = "conv_id bigint, turn bigint, h string, mark bigint, edits string, " + ", ".join(f"{c} bigint" for c in _TOTALS)


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 1 + sum(len(v) for v in r.values() if isinstance(v, str))
        if size > 4_000_000 or len(held) >= 10_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _illegal(before: str | None, after: str) -> int:
    return int(before is not None and before + after not in LEGAL)


def _symbol(initial: str, truncated: bool) -> str:
    s = initial if initial in ("s", "u", "a") else "o"
    return s.upper() if truncated else s


def _spans(batches) -> Iterator[pa.RecordBatch]:
    """Runs of equal rows, sorted -> one row per conversation of the partition: its faults and the cell of its rows."""

    def out():
        for conv, runs in groupby(_rows(batches), lambda r: r["conv_id"]):
            s = {k: 0 for k in ("blank", "duplicate", "truncated", "illegal", "turns")} | {
                "conv_id": conv, "first": None, "last": None, "min_turn": None, "max_turn": None}
            symbols = []
            for r in runs:
                n, initial, turn = r["n"], r["initial"], r["turn"]
                if s["first"] is None:
                    s |= {"turn": turn, "h": r["h"], "first": initial}
                s["illegal"] += _illegal(s["last"], initial) + (n - 1) * _illegal(initial, initial)
                s["last"] = initial
                if turn is not None and turn != s["max_turn"]:
                    s["turns"] += 1
                    s["max_turn"] = turn
                    s["min_turn"] = turn if s["min_turn"] is None else s["min_turn"]
                if r["fault"] == "blank":
                    s["blank"] += n
                    symbols.append("x" * n)
                else:
                    first = 0 if r["again"] else 1
                    s["duplicate"] += n - first
                    s["truncated"] += first * (r["fault"] == "truncated")
                    symbols.append(_symbol(initial, r["fault"] == "truncated") * first + "x" * (n - first))
            cell = span_cell("".join(symbols))
            yield s | {"marks": [4 * p + q for p, q in cell], "costs": [c for c, _ in cell.values()],
                       "audits": [a for _, a in cell.values()]}

    return _batched(out(), _SPAN)


def _edits(batches) -> Iterator[pa.RecordBatch]:
    """Spans of each conversation in order -> the edits of each, and the conversation's totals with its first span."""

    def out():
        for conv, group in groupby(_rows(batches), lambda r: r["conv_id"]):
            spans = list(group)
            cost, parts = chosen([{divmod(m, 4): (c, a) for m, c, a in zip(s["marks"], s["costs"], s["audits"])} for s in spans])
            totals = {k: sum(s[k] for s in spans) for k in ("blank", "duplicate", "truncated", "illegal")} | {"cost": cost, "gaps": 0}
            turns, low, high = 0, None, None
            for before, s in zip([None, *spans], spans):
                if before:
                    totals["illegal"] += _illegal(before["last"], s["first"])
                if s["turns"]:
                    turns += s["turns"] - (s["min_turn"] == high)
                    low, high = s["min_turn"] if low is None else low, s["max_turn"]
            if turns:
                totals["gaps"] = high - low + 1 - turns
            for k, (s, (mark, audit)) in enumerate(zip(spans, parts)):
                yield {"conv_id": conv, "turn": s["turn"], "h": s["h"], "mark": mark, "edits": audit} | (totals if k == 0 else {})

    return _batched(out(), _EDITS)


_ORDER = ("conv_id", "turn", "h")


def _faulted(df: DataFrame) -> DataFrame:
    """Rows with the hash that orders the rows of one turn and tells repeats."""
    turns = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                      F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    return turns.withColumn("h", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def edits(df: DataFrame) -> DataFrame:
    """Each conversation's spans (conv_id, turn and h of its first row) with their edits, and with the first span the totals
    gaps, blank, duplicate, truncated, illegal and cost; see ``repaired`` for the order of rows and the awkward cases."""
    rows = _faulted(df)
    end = let(F.rtrim("text", F.lit(BLANKS)), lambda t: F.when(t == "", "blank").when(
        ~F.right(t, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("whole"))
    runs = stored(rows.select(*_ORDER, F.left("role", F.lit(1)).alias("initial"), end.alias("fault")).groupBy(
        *_ORDER, "initial", "fault").agg(F.count("*").alias("n")), "runs")
    several = runs.groupBy(F.col("conv_id").alias("_c"), F.col("h").alias("_h")).agg(
        F.min(F.struct("turn")).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = F.col("_first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("_first"))  # a struct: null turns come first
    marked = runs.join(several, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h") == F.col("_h")), "left").select(
        *_ORDER, "initial", "fault", "n", again.alias("again"))
    spans = marked.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(_spans, _SPAN_DDL)
    return spans.repartition("conv_id").sortWithinPartitions(*_ORDER).mapInArrow(_edits, _EDITS_DDL)


_PUT = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_PUT_DDL = "conv_id bigint, seq bigint, edit string, role string, text string"


def _put(rows: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
    """The rows of one conversation, each span's edits before its rows -> (edit, role, text) in order."""
    mark, todo, at = 0, "", 0

    def needed() -> str:
        return "a" if mark == 2 else "u"

    def inserted():
        nonlocal mark, at
        while at < len(todo) and todo[at] == INSERT:
            initial = needed()
            mark, at = MOVES[mark, initial], at + 1
            yield INSERT, ROLES[initial], ""

    for r in rows:
        if r["edits"] is not None:
            yield from inserted()
            mark, todo, at = r["mark"], r["edits"], 0
        elif r["text"] is not None:
            yield from inserted()
            edit, role, at = todo[at], r["role"], at + 1
            if edit == REROLE:
                role = ROLES[needed()]
            if edit != DELETE:
                mark = MOVES[mark, role[:1]]
            yield edit, role, r["text"]
    yield from inserted()


def _ordered(df: DataFrame) -> DataFrame:
    """All rows and, before the first row of each span, its edits: every conversation in one partition, in order."""
    found = edits(df)
    kinds = found.select(*_ORDER, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                         "mark", "edits", *_TOTALS)
    rows = _faulted(df).select(*_ORDER, F.lit(1).alias("kind"), "role", "text", *[
        F.lit(None).cast("string" if c == "edits" else "bigint").alias(c) for c in ("mark", "edits", *_TOTALS)])
    return kinds.unionByName(rows)


def repaired(df: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with the cheapest edits: conv_id, seq, edit (K, R, D or I), role, text.

    ``seq`` counts the repaired rows from 0 and is null for deleted ones, which show what they held. Rows go by turn, nulls
    first; those of one turn by a hash of role and text. A null role or text is one blank; a role whose first character is
    not s, u or a, or that is empty, can't be kept. Rows that repeat are turns of their own. Rows of a null conv_id are one
    conversation. Other columns are not read. An empty table gives an empty one. A conversation's rows pass through one
    task as a stream, one row in memory."""

    def run(batches):
        def out():
            for conv, rows in groupby(_rows(batches), lambda r: r["conv_id"]):
                seq = 0
                for edit, role, text in _put(rows):
                    yield {"conv_id": conv, "seq": None if edit == DELETE else seq, "edit": edit, "role": role, "text": text}
                    seq += edit != DELETE

        return _batched(out(), _PUT)

    return _ordered(df).repartition("conv_id").sortWithinPartitions(*_ORDER, "kind").mapInArrow(run, _PUT_DDL)


_FOUND = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _TOTALS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_FOUND_DDL = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in _TOTALS) + ", audit string, repaired_sha256 string"


def summary(df: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """One row per conversation of ``df`` or ``conv_ids`` (conv_id): its faults, the cost and audit of its edits, and the
    digest of the repaired rows (``role:text``, joined by newlines). A conversation without rows: zeros and the digest of
    nothing. ``repaired`` says the rest."""
    only = conv_ids.select(F.col("conv_id").cast("long")).distinct()
    marks = only.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("h"), F.lit(-1).alias("kind"), *[
        F.lit(None).cast("string" if c in ("role", "text", "edits") else "bigint").alias(c) for c in ("role", "text", "mark", "edits", *_TOTALS)])

    def run(batches):
        def out():
            for conv, rows in groupby(_rows(batches), lambda r: r["conv_id"]):
                totals, audit, digest, n = dict.fromkeys(_TOTALS, 0), [], hashlib.sha256(), 0

                def seen():
                    for r in rows:
                        if r["edits"] is not None:
                            audit.append(r["edits"])
                            if r["cost"] is not None:
                                totals.update({c: r[c] for c in _TOTALS})
                        yield r

                for edit, role, text in _put(seen()):
                    if edit != DELETE:
                        digest.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                        n += 1
                yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()} | totals

        return _batched(out(), _FOUND)

    return _ordered(df).unionByName(marks).repartition("conv_id").sortWithinPartitions(*_ORDER, "kind").mapInArrow(run, _FOUND_DDL)


def damaged(df: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20; nulls are one blank."""
    way = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                           F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = df.select("conv_id", "turn", way.alias("_way"), F.when(way == 4, "user").otherwise(role).alias("role"),
                     F.when(way == 1, "").when(way == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_way") == 0, 0).when(
        F.col("_way") == 3, 2).otherwise(1)))).drop("_way", "_copy")


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged, and repaired."""
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return summary(damaged(turns), turns)


#: The same least edits, row by row along the marks (the table ``w`` lists what a row, or none, may become).
SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i::UBIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
z AS (SELECT k.*, xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(
      range(1, strlen(key) + 1), lambda i: ord(key[i])::UBIGINT),
      lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255)::BIGINT + 1]))) % 20 AS way FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
    CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM z, range(CASE way WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) c(n)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS e FROM d),
f AS (SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS px,
    CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
t AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
m(p, x, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins(p, q, ic, ia, io) AS (
  SELECT p, p, 0, '', []::VARCHAR[] FROM (VALUES (0), (1), (2), (3)) v(p)
  UNION ALL SELECT ins.p, m.q, ic + 2, ia || 'I', list_append(io, m.x) FROM ins JOIN m ON m.p = ins.q AND m.x <> 's' WHERE ic < 8),
w AS (SELECT f.conv_id, f.i, m.p, m.q, 'K' AS a, (fault = 'truncated')::INT AS c, role || ':' || text AS line
    FROM f JOIN m ON m.x = f.x WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT f.conv_id, f.i, m.p, m.q, 'R', 2 + (fault = 'truncated')::INT,
    CASE m.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
    FROM f JOIN m ON m.x <> 's' AND m.x <> f.x WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT f.conv_id, f.i, v.p, v.p, 'D', 3, NULL FROM f, (VALUES (0), (1), (2), (3)) v(p)),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM t
  UNION ALL
  SELECT conv_id, i, q, s.cost, s.audit, s.lines FROM (
    SELECT best.conv_id, w.i, w.q, min({cost: best.cost + ic + w.c, audit: best.audit || ia || w.a,
      lines: best.lines || list_transform(io, lambda x: CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END)
        || CASE WHEN w.line IS NULL THEN []::VARCHAR[] ELSE [w.line] END}) AS s
    FROM best JOIN ins ON ins.p = best.q JOIN w ON w.conv_id IS NOT DISTINCT FROM best.conv_id AND w.i = best.i + 1 AND w.p = ins.q
    GROUP BY ALL)),
done AS (SELECT conv_id, min({cost: cost + ic, audit: audit || ia, lines: lines
      || list_transform(io, lambda x: CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END)}) AS s
  FROM best JOIN t USING (conv_id) JOIN ins ON ins.p = best.q AND ins.q IN (0, 3) WHERE best.i = t.n GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.cost, 0)::BIGINT AS cost,
  coalesce(s.audit, '') AS audit, sha256(coalesce(array_to_string(s.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN t USING (conv_id) LEFT JOIN done USING (conv_id)
"""
