"""Chat formatting with a compiled, sandboxed template.

A template is parsed into a syntax tree, constant parts of the tree are folded, and each node becomes a Python closure; the
closures render a conversation as a stream of pieces, each marked as inside or outside a generation block (the loss mask).

The language: text; ``{{ expression }}``; ``{% for m in messages %}`` ... ``{% endfor %}``; ``{% if e %}``, ``{% elif e %}``,
``{% else %}``, ``{% endif %}``; ``{% generation %}`` ... ``{% endgeneration %}``; ``{# comment #}``. A ``-`` inside a tag's
mark strips white space on that side. Expressions: strings, whole numbers, true, false, none, names, ``a.b`` and ``a['b']``
(fields of a message, and ``loop.index0``, ``loop.first``), ``+ == != and or not ~``, parentheses, and ``| filter`` with
the filters of ``FILTERS``. Nothing else can be reached: no attribute of a Python object, no call, no loop but over the
messages, so a template ends and touches nothing outside.

On Spark, a conversation's rows meet in one task, sorted, and are rendered as they stream by: what is in memory is one turn,
also where one conversation holds a third of all rows. The output has one row per turn, the pieces of a conversation in
order, with the spans of the loss mask. ``parsed`` reads that output back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import read

#: Marks of a turn. ``escape`` keeps them out of roles and texts.
TURN, SAYS, END = "<turn ", ">\n", "</turn>\n"

DEFAULT = ("{% for m in messages %}" + TURN + "{{ m.role | escape }}" + SAYS +
           "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
           "{% else %}{{ m.text | escape }}{% endif %}" + END + "{% endfor %}")


class TemplateError(ValueError):
    """A template that the language doesn't allow, or a value that it can't be applied to."""


def escape(s: str) -> str:
    """A backslash before each backslash, ``<`` and ``>``: no mark can then be read in the result. See ``unescape``."""
    return s.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}

# Syntax tree: tuples of a kind and its parts.
#   expressions  ("const", value) ("name", name) ("field", e, key) ("filter", name, e) (operator, e, ...)
#   statements   ("text", str) ("emit", e) ("for", name, body) ("if", [(condition, body)]) ("generation", body)
_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[+~|.()\[\]]))""")
_WORDS = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(next((k, g) for k, g in zip(("int", "str", "word", "op"), m.groups()) if g is not None))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        tree = self.any_of()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def any_of(self):
        return self.chain(("or",), lambda: self.chain(("and",), self.negation))

    def chain(self, ops, below):
        tree = below()
        while self.peek(*ops):
            tree = (self.take(*ops), tree, below())
        return tree

    def negation(self):
        if self.peek("not"):
            self.take("not")
            return ("not", self.negation())
        return self.chain(("==", "!="), lambda: self.chain(("+", "~"), self.filtered))

    def filtered(self):
        tree = self.primary()
        while self.peek("|"):
            self.take("|")
            kind, name = self.next()
            if kind != "word" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def next(self):
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too soon")
        self.at += 1
        return self.tokens[self.at - 1]

    def primary(self):
        kind, value = self.next()
        if kind == "int":
            tree = ("const", int(value))
        elif kind == "str":
            tree = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "word" and value not in ("and", "or", "not"):
            tree = ("const", _WORDS[value]) if value in _WORDS else ("name", value)
        elif value == "(":
            tree = self.any_of()
            self.take(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek(".", "["):
            if self.take(".", "[") == ".":
                kind, key = self.next()
                if kind != "word":
                    raise TemplateError("a field's name must follow the dot")
                tree = ("field", tree, key)
            else:
                key = self.any_of()
                self.take("]")
                if key[0] != "const" or not isinstance(key[1], str):
                    raise TemplateError("only constant strings index a message")
                tree = ("field", tree, key[1])
        return tree


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    parts, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        parts.append(("text", text.rstrip() if m[0][2] == "-" else text))
        if not m[0].startswith("{#"):
            parts.append(("emit", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        strip, at = m[0][-3] == "-", m.end()
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    if any(re.search(r"\{[{%#]|[%#}]\}", x) for k, x in parts if k == "text"):
        raise TemplateError("a tag is not closed or not opened")
    queue = [p for p in parts if p != ("text", "")]
    body, end = _body(queue, 0, ())
    return body


def _body(parts: list, at: int, ends: tuple) -> tuple[list, int]:
    """Statements up to a tag that begins with one of ``ends`` (or the end), and where that tag is."""
    out = []
    while at < len(parts):
        kind, source = parts[at]
        if kind == "text":
            out.append((kind, source))
        elif kind == "emit":
            out.append((kind, _Expression(source).whole()))
        else:
            word, _, rest = source.partition(" ")
            if word in ends:
                return out, at
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
                if not m or m[1] in (*_WORDS, "loop", "messages"):
                    raise TemplateError(f"a loop must run over messages: {source!r}")
                body, at = _body(parts, at + 1, ("endfor",))
                out.append(("for", m[1], body))
            elif word == "generation" and not rest.strip():
                body, at = _body(parts, at + 1, ("endgeneration",))
                out.append(("generation", body))
            elif word == "if":
                arms, condition = [], _Expression(rest).whole()
                while True:
                    body, at = _body(parts, at + 1, ("elif", "else", "endif") if condition is not None else ("endif",))
                    arms.append((condition or ("const", True), body))
                    word, _, rest = parts[at][1].partition(" ")
                    if word == "endif":
                        break
                    condition = _Expression(rest).whole() if word == "elif" else None
                out.append(("if", arms))
            else:
                raise TemplateError(f"unknown tag {source!r}")
        at += 1
    if ends:
        raise TemplateError(f"{' or '.join(ends)} is missing")
    return out, at


def _text(v) -> str:
    return "" if v is None else str(v)


def _apply(op: str, *v):
    if op == "not":
        return not v[0]
    if op == "==":
        return v[0] == v[1]
    if op == "!=":
        return v[0] != v[1]
    if op == "~" or isinstance(v[0], str) or isinstance(v[1], str):
        return _text(v[0]) + _text(v[1])
    if not all(isinstance(x, int) for x in v):
        raise TemplateError(f"{op} takes texts or numbers")
    return v[0] + v[1]


def fold_expression(e: tuple) -> tuple:
    """The expression with its constant parts worked out."""
    if e[0] in ("const", "name"):
        return e
    if e[0] == "field":
        return ("field", fold_expression(e[1]), e[2])
    if e[0] == "filter":
        inner = fold_expression(e[2])
        return ("const", FILTERS[e[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", e[1], inner)
    parts = [fold_expression(x) for x in e[1:]]
    if e[0] in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (e[0] == "and") else parts[0]
    if all(p[0] == "const" for p in parts):
        return ("const", (parts[0][1] and parts[1][1]) if e[0] == "and" else (parts[0][1] or parts[1][1]) if e[0] == "or"
                else _apply(e[0], *(p[1] for p in parts)))
    return (e[0], *parts)


def fold(body: list[tuple]) -> list[tuple]:
    """The statements with constants folded: constant output becomes text, decided branches go, adjacent texts join."""
    out: list[tuple] = []
    for s in body:
        new: list[tuple] = [s]
        if s[0] == "emit":
            e = fold_expression(s[1])
            new = [("text", _text(e[1]))] if e[0] == "const" else [("emit", e)]
        elif s[0] == "for":
            new = [("for", s[1], fold(s[2]))]
        elif s[0] == "generation":
            new = [("generation", fold(s[1]))]
        elif s[0] == "if":
            arms = []
            for condition, inner in s[1]:
                c = fold_expression(condition)
                if c[0] != "const" or c[1]:
                    arms.append((c, fold(inner)))
                if c[0] == "const" and c[1]:
                    break
            new = list(arms[0][1]) if arms and arms[0][0][0] == "const" else [("if", arms)] if arms else []
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


def _closure(e: tuple) -> Callable[[dict], object]:
    """An expression as a function of the names in scope."""
    kind = e[0]
    if kind == "const":
        return lambda scope: e[1]
    if kind == "name":
        if e[1] == "messages":
            raise TemplateError("messages can only be looped over")
        return lambda scope: scope.get(e[1])
    if kind == "field":
        of = _closure(e[1])

        def field(scope):
            holder = of(scope)
            if holder is not None and type(holder) is not dict:
                raise TemplateError(f"{e[2]} is asked of a value without fields")
            return None if holder is None else holder.get(e[2])

        return field
    if kind == "filter":
        of, change = _closure(e[2]), FILTERS[e[1]]
        return lambda scope: change(_text(of(scope)))
    parts = [_closure(x) for x in e[1:]]
    if kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    return lambda scope: _apply(kind, *(p(scope) for p in parts))


Piece = tuple[str, bool, int]  # text, under the loss mask, number of the message it belongs to


def _statements(body: list[tuple], masked: bool = False) -> Callable[[dict, Iterable[dict]], Iterator[Piece]]:
    """Statements as a function that yields pieces."""
    steps = []
    for s in body:
        if s[0] == "text":
            steps.append(lambda scope, messages, t=s[1]: iter(((t, masked, scope.get("_at", 0)),)))
        elif s[0] == "emit":
            steps.append(lambda scope, messages, f=_closure(s[1]): iter(((_text(f(scope)), masked, scope.get("_at", 0)),)))
        elif s[0] == "generation":
            steps.append(_statements(s[1], True))
        elif s[0] == "for":
            def loop(scope, messages, name=s[1], inner=_statements(s[2], masked)):
                for i, m in enumerate(messages):
                    yield from inner(scope | {name: m, "loop": {"index0": i, "first": i == 0}, "_at": i}, messages)
                    scope["_at"] = i

            steps.append(loop)
        else:
            arms = [(_closure(c), _statements(b, masked)) for c, b in s[1]]

            def branch(scope, messages, arms=arms):
                return next((run(scope, messages) for c, run in arms if c(scope)), iter(()))

            steps.append(branch)

    def run(scope: dict, messages: Iterable[dict]) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, messages)

    return run


def compiled(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """The renderer of a template: messages (dicts of role and text) to pieces, as they come."""
    tree = fold(parse(source))
    if sum(_loops(tree)) > 1:
        raise TemplateError("the messages stream by once: one loop")
    run = _statements(tree)
    return lambda messages: run({}, messages)


def _loops(body: list[tuple]) -> Iterator[int]:
    for s in body:
        if s[0] == "for":
            yield 1
            yield from (2 for _ in _loops(s[2]))
        elif s[0] == "generation":
            yield from _loops(s[1])
        elif s[0] == "if":
            for _, inner in s[1]:
                yield from _loops(inner)


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()),
                        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_DDL = "conv_id bigint, piece bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"


def _grouped(rows: Iterator[dict]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Runs of rows of one conv_id; each run must be used up before the next."""
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead["conv_id"]

        def run():
            nonlocal ahead
            while ahead is not None and ahead["conv_id"] == key:
                now, ahead = ahead, next(rows, None)
                yield now

        group = run()
        yield key, group
        for _ in group:
            pass


def _batched(rows: Iterator[dict], schema: pa.Schema, chars: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 1 + chars(r)
        if size > 4_000_000 or len(held) >= 10_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def formatted(df: DataFrame, template: str = DEFAULT) -> DataFrame:
    """Conversations (conv_id, turn, role, text) rendered: one row per turn with conv_id, piece (from 0, in order),
    formatted and loss (spans under the loss mask, code points of ``formatted``; adjoining ones are one).

    Turns go by ``turn``, then role and text, nulls first; rows that repeat are turns of their own. A null role or text is
    empty; rows of a null conv_id are one conversation. Other columns are not read. An empty table gives an empty one.
    What a template writes after its loop belongs to the last turn's row."""
    compiled(template)  # a wrong template fails here and not in a task

    def run(batches):
        render = compiled(template)

        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        def out():
            for key, group in _grouped(rows()):
                messages = ({"role": m["role"] or "", "text": m["text"] or ""} for m in group)
                n, parts, size, loss = 0, [], 0, []
                for text, masked, at in render(messages):
                    if at != n:
                        yield {"conv_id": key, "piece": n, "formatted": "".join(parts), "loss": loss}
                        n, parts, size, loss = at, [], 0, []
                    if masked:
                        if loss and loss[-1]["end"] == size:
                            loss[-1]["end"] += len(text)
                        else:
                            loss.append({"start": size, "end": size + len(text)})
                    parts.append(text)
                    size += len(text)
                yield {"conv_id": key, "piece": n, "formatted": "".join(parts), "loss": loss}

        yield from _batched(out(), _FORMATTED, lambda r: len(r["formatted"]))

    turns = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    turns = turns.repartition("conv_id").sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")])
    return turns.mapInArrow(run, _DDL)


_PARSED = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_ESCAPED = r"([^\\<>]*(?:\\.[^\\<>]*)*)"
_PIECE = re.compile(f"<turn {_ESCAPED}>\n{_ESCAPED}</turn>\n", re.S)


def parsed(df: DataFrame) -> DataFrame:
    """Output of ``formatted`` under ``DEFAULT`` read back: one row per conversation with the digests of its turns (role,
    newline, text, newline each) and of the text under its loss mask, both unescaped. Raises on text that isn't its
    output. The digests run along with the rows, so a conversation is never whole in memory."""

    def run(batches):
        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        def out():
            for key, group in _grouped(rows()):
                turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for r in group:
                    text, at = r["formatted"], 0
                    chars += len(text)
                    while at < len(text):
                        m = _PIECE.match(text, at)
                        if not m:
                            raise ValueError(f"conversation {key}, piece {r['piece']}: no turn at {at}")
                        turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                        n, at = n + 1, m.end()
                    for span in r["loss"]:
                        said = unescape(text[span["start"] : span["end"]])
                        loss.update(said.encode())
                        loss_chars += len(said)
                yield {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars,
                       "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

        yield from _batched(out(), _PARSED, lambda r: 0)

    pieces = df.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "piece")
    return pieces.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                  "loss_sha256 string, formatted_chars bigint")


HARD = "\\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7, formatted and read back."""
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    return parsed(formatted(turns.unionByName(extra)))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, length(role) + length(text)
    + len(regexp_extract_all(role || text, '[\\<>]')) + 16 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
