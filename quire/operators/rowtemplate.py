"""T1 with a template of its own in every row: the language of ``quire.operators.templates``, read and evaluated in the row.

``compile_template`` turns one template of a job into one Column; here the template is data. Its text is cut into tokens, and
one ``aggregate`` over them is the evaluator: its state is the output so far and a stack of open blocks. Loops need no jump
back, since a loop runs for all of its values at once: each value is a *lane* with its own output and scope, every token is
applied to all lanes, and ``$endfor$`` joins the lanes of a loop back into the lanes around it. ``$if$`` switches lanes
off. What stands outside of loops goes to the output itself (``main``), an array of pieces that no lambda binds: Spark copies
what it binds, strings included, and a document's body must not be copied once per token.

The results are those of ``compile_template`` (tests hold the two against each other); where that raises when a job starts,
here the row gets the same message as its error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.codecs import let

TOKEN_RE = r"\$\$|\$(if|for)\(([A-Za-z0-9_.-]+)\)\$|\$(else|endif|sep|endfor)\$|\$([A-Za-z0-9_.-]+)\$"

_SCOPE = "array<struct<k:string,v:string>>"
_LANE = f"struct<out:array<string>,on:boolean,scope:{_SCOPE}>"
_FRAME = f"struct<kind:string,name:string,second:boolean,lanes:array<{_LANE}>,starts:array<int>,bodies:array<string>>"
_STATE = f"struct<main:array<string>,depth:int,lanes:array<{_LANE}>,stack:array<{_FRAME}>,err:string,at:int>"


def _none(of: str) -> Column:
    return F.array().cast(f"array<{of}>")


def _lane(out: Column, on: Column, scope: Column) -> Column:
    return F.struct(out.alias("out"), on.alias("on"), scope.alias("scope"))


def _frame(kind, name, second, lanes, starts, bodies) -> Column:
    return F.struct(kind.alias("kind"), name.alias("name"), second.alias("second"), lanes.alias("lanes"), starts.alias("starts"),
                    bodies.alias("bodies"))


def _state(main, depth, lanes, stack, err, at) -> Column:
    return F.struct(main.alias("main"), depth.cast("int").alias("depth"), lanes.alias("lanes"), stack.alias("stack"),
                    err.cast("string").alias("err"), at.cast("int").alias("at"))


def tokens(src: Column) -> Column:
    """The template as (text, kind, name, raw): the text before each token, then the token. Kinds: ``if for else endif sep
    endfor var``, ``$`` for a literal dollar, and an empty one after the last text."""
    def one(text, raw):
        word = F.regexp_extract(raw, r"^\$(if|for)\(", 1)
        closing = F.regexp_extract(raw, r"^\$(else|endif|sep|endfor)\$$", 1)
        kind = (F.when(raw.isNull(), "").when(raw == "$$", "$").when(word != "", word).when(closing != "", closing).otherwise("var"))
        return F.struct(text.alias("text"), kind.alias("kind"), F.regexp_extract(raw, r"([A-Za-z0-9_.-]+)\)?\$$", 1).alias("name"),
                        raw.alias("raw"))

    return F.zip_with(F.split(src, TOKEN_RE, -1), F.regexp_extract_all(src, F.lit(TOKEN_RE), 0), one)


def _in_scope(lane: Column, name: Column) -> Column:
    """The innermost binding of a loop variable, null when there is none."""
    return F.get(F.filter(lane["scope"], lambda e: e["k"] == name), F.lit(0))


def render_row(src: Column, vars_col: Column, body: Column) -> Column:
    """(text, error) of the template ``src`` over ``vars_col`` (map of string arrays) and ``body``; one of the two is null,
    both for a null template."""
    def values(lane, name):
        hit = _in_scope(lane, name)
        return F.when(hit.isNotNull(), F.array(hit["v"])).when(name == "body", F.array(body)).otherwise(
            F.coalesce(F.try_element_at(vars_col, name), _none("string")))

    def pieces(lane, t):
        hit = _in_scope(lane, t["name"])
        value = F.when(hit.isNotNull(), hit["v"]).otherwise(F.array_join(values(lane, t["name"]), ""))
        return F.filter(F.array(t["text"], F.when(t["kind"] == "var", value).when(t["kind"] == "$", F.lit("$"))),
                        lambda p: F.coalesce(p != "", F.lit(False)))

    def written(lane, t):
        return F.when(lane["on"], _lane(F.concat(lane["out"], pieces(lane, t)), lane["on"], lane["scope"])).otherwise(lane)

    def written_main(acc, t):
        """A body is put in by reference: no lambda binds it."""
        lane = F.get(acc["lanes"], F.lit(0))
        return F.when((acc["depth"] == 0) & lane["on"], F.concat(acc["main"], F.when(
            (t["kind"] == "var") & (t["name"] == "body"), F.array(t["text"], F.coalesce(body, F.lit("")))).otherwise(pieces(lane, t)))).otherwise(acc["main"])

    def whole(lane):
        return F.array_join(lane["out"], "")

    def fault(acc, top, t):
        kind, at = t["kind"], (acc["at"] + F.length(t["text"])).cast("string")
        opened = F.concat(F.lit("$"), top["kind"], F.lit("("), top["name"], F.lit(")$"))
        own = F.when(kind.isin("else", "endif"), "if").otherwise("for")
        return F.when(kind.isin("else", "sep", "endif", "endfor"), F.when(
            top.isNull(), F.concat(F.lit("$"), kind, F.lit("$ without an open block at offset "), at))
            .when(kind.isin("else", "sep") & ((top["kind"] != own) | top["second"]), F.concat(F.lit("$"), kind, F.lit("$ does not belong to "), opened))
            .when(top["kind"] != own, F.concat(F.lit("$"), kind, F.lit("$ closes "), opened)))

    def opened_if(lanes, t):
        true = lambda lane: F.coalesce(F.exists(values(lane, t["name"]), lambda x: x != ""), F.lit(False))
        return F.transform(lanes, lambda lane: _lane(lane["out"], lane["on"] & true(lane), lane["scope"]))

    def opened_for(lanes, t):
        """(lanes of the loop, frame); the lanes of one outer lane are next to each other, from its start on."""
        each = F.transform(lanes, lambda lane: F.when(lane["on"], values(lane, t["name"])).otherwise(_none("string")))
        starts = lambda vs: F.aggregate(vs, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + F.size(v))))
        inner = lambda vs: F.flatten(F.transform(lanes, lambda lane, i: F.transform(F.get(vs, i), lambda v: _lane(
            _none("string"), F.lit(True), F.concat(F.array(F.struct(t["name"].alias("k"), F.coalesce(v, F.lit("")).alias("v"))), lane["scope"])))))
        return let(each, lambda vs: F.struct(inner(vs).alias("lanes"), _frame(
            t["kind"], t["name"], F.lit(False), lanes, starts(vs), _none("string")).alias("frame")))

    def joined_bodies(lanes, top):
        """What the loop gives each of the lanes around it."""
        bodies = F.when(top["second"], top["bodies"]).otherwise(F.transform(lanes, whole))
        seps = F.when(top["second"], F.transform(lanes, whole)).otherwise(_none("string"))
        part = lambda bs, i: F.slice(bs, F.get(top["starts"], i) + 1, F.get(top["starts"], i + 1) - F.get(top["starts"], i))
        joined = lambda bs, ss, i: F.array_join(F.transform(part(bs, i), lambda b, n: F.concat(
            F.when(n > 0, F.coalesce(F.get(ss, i), F.lit(""))).otherwise(F.lit("")), b)), "")
        return let(F.struct(bodies.alias("b"), seps.alias("s")), lambda x: F.transform(
            top["lanes"], lambda lane, i: joined(x["b"], x["s"], i)))

    def step(acc, t):
        at = acc["at"] + F.length(t["text"]) + F.coalesce(F.length(t["raw"]), F.lit(0))
        kind, stack, depth = t["kind"], acc["stack"], acc["depth"]
        rest = F.slice(stack, 2, F.size(stack))
        top = F.get(stack, F.lit(0))
        push = lambda frame, below: F.concat(F.array(frame), below)
        err = F.coalesce(acc["err"], fault(acc, top, t))
        main = written_main(acc, t)
        lanes = F.when(depth > 0, F.transform(acc["lanes"], lambda lane: written(lane, t))).otherwise(acc["lanes"])
        now = lambda ls, stack, main=main, depth=depth: _state(main, depth, ls, stack, F.lit(None), at)
        second = lambda bodies: _frame(top["kind"], top["name"], F.lit(True), top["lanes"], top["starts"], bodies)
        opened = opened_for(lanes, t)
        closed = let(joined_bodies(lanes, top), lambda js: F.struct(js.alias("js"), F.zip_with(top["lanes"], js, lambda lane, j: _lane(
            F.when(depth > 1, F.concat(lane["out"], F.array(j))).otherwise(lane["out"]), lane["on"], lane["scope"])).alias("lanes")))
        return (F.when(err.isNotNull(), _state(acc["main"], depth, acc["lanes"], stack, err, acc["at"]))
                .when(kind.isin("", "$", "var"), now(lanes, stack))
                .when(kind == "if", now(opened_if(lanes, t), push(_frame(kind, t["name"], F.lit(False), lanes, _none("int"), _none("string")), stack)))
                .when(kind == "for", now(opened["lanes"], push(opened["frame"], stack), main, depth + 1))
                .when(kind == "else", now(F.zip_with(lanes, top["lanes"], lambda a, b: _lane(a["out"], b["on"] & ~a["on"], a["scope"])),
                                          push(second(_none("string")), rest)))
                .when(kind == "endif", now(F.zip_with(lanes, top["lanes"], lambda a, b: _lane(a["out"], b["on"], a["scope"])), rest))
                .when(kind == "sep", now(F.transform(top["lanes"], lambda a: _lane(_none("string"), a["on"], a["scope"])),
                                         push(second(F.transform(lanes, whole)), rest)))
                .otherwise(now(closed["lanes"], rest, F.when(depth == 1, F.concat(main, closed["js"])).otherwise(main), depth - 1)))

    def done(acc):
        top = F.get(acc["stack"], F.lit(0))
        err = F.coalesce(acc["err"], F.when(top.isNotNull(), F.concat(F.lit("$"), top["kind"], F.lit("("), top["name"], F.lit(")$ is not closed"))))
        return F.struct(F.when(err.isNull(), F.array_join(acc["main"], "")).alias("text"), err.alias("error"))

    start = _state(_none("string"), F.lit(0), F.array(_lane(_none("string"), F.lit(True), F.array().cast(_SCOPE))), _none(_FRAME), F.lit(None), F.lit(0)).cast(_STATE)
    return F.when(src.isNotNull(), F.aggregate(tokens(src), start, step, done))
