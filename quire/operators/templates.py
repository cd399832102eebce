"""Templates and metadata (T1 template_render, T2 includes, T3 merge_metadata).

T1 language (the variable syntax of the reference's document template): ``$name$``, ``$if(name)$..$else$..$endif$``,
``$for(name)$..$sep$..$endfor$``, ``$$`` for a literal dollar; names may hold ``-``. ``$body$`` is the converted
content. Evaluation (ours): a missing variable is empty; ``if`` is true when the variable has at least one non-empty
value; inside ``for(v)``, ``$v$`` is the current value; outside a loop the values of a variable are joined without
separator.

The template is parsed once on the driver (it is job configuration, a few KB) and compiled to one Column expression
over ``vars map<string, array<string>>`` and the body column: ``concat``, ``when`` and ``array_join(transform(..))``.
Nothing per row runs in Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.codecs import html_escape

_TOKEN = re.compile(r"\$\$|\$(if|for)\(([A-Za-z0-9_.-]+)\)\$|\$(else|endif|sep|endfor)\$|\$([A-Za-z0-9_.-]+)\$")


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    kind: str  # text | var | if | for
    value: str = ""
    body: list = field(default_factory=list)
    alt: list = field(default_factory=list)  # else branch / separator


def parse_template(src: str) -> list[Node]:
    """Template text -> node list. Unbalanced blocks are errors raised at job start, not per row."""
    root: list[Node] = []
    stack: list[tuple[Node, str]] = []  # (node, 'body' | 'alt')
    out = root
    pos = 0
    for m in _TOKEN.finditer(src):
        if m.start() > pos:
            out.append(Node("text", src[pos:m.start()]))
        pos = m.end()
        tok = m.group(0)
        if tok == "$$":
            out.append(Node("text", "$"))
        elif m.group(1):
            node = Node(m.group(1), m.group(2))
            out.append(node)
            stack.append((node, "body"))
            out = node.body
        elif m.group(3):
            kw = m.group(3)
            if not stack:
                raise TemplateError(f"${kw}$ without an open block at offset {m.start()}")
            node, part = stack[-1]
            if kw in ("else", "sep"):
                want = "if" if kw == "else" else "for"
                if node.kind != want or part != "body":
                    raise TemplateError(f"${kw}$ does not belong to ${node.kind}({node.value})$")
                stack[-1] = (node, "alt")
                out = node.alt
            else:
                want = "if" if kw == "endif" else "for"
                if node.kind != want:
                    raise TemplateError(f"${kw}$ closes ${node.kind}({node.value})$")
                stack.pop()
                out = root if not stack else (stack[-1][0].body if stack[-1][1] == "body" else stack[-1][0].alt)
        else:
            out.append(Node("var", m.group(4)))
    if pos < len(src):
        out.append(Node("text", src[pos:]))
    if stack:
        raise TemplateError(f"${stack[-1][0].kind}({stack[-1][0].value})$ is not closed")
    return root


def _values(name: str, vars_col: Column, body: Column) -> Column:
    if name == "body":
        return F.array(body)
    return F.coalesce(F.try_element_at(vars_col, F.lit(name)), F.array().cast("array<string>"))


def _compile(nodes: list[Node], vars_col: Column, body: Column, scope: dict[str, Column]) -> Column:
    parts: list[Column] = []
    for n in nodes:
        if n.kind == "text":
            parts.append(F.lit(n.value))
        elif n.kind == "var":
            if n.value in scope:
                parts.append(scope[n.value])
            elif n.value == "body":
                parts.append(body)
            else:
                parts.append(F.array_join(_values(n.value, vars_col, body), ""))
        elif n.kind == "if":
            if n.value in scope:
                cond = scope[n.value] != ""
            else:
                cond = F.exists(_values(n.value, vars_col, body), lambda x: x != "")
            yes = _compile(n.body, vars_col, body, scope)
            no = _compile(n.alt, vars_col, body, scope)
            parts.append(F.when(cond, yes).otherwise(no))
        else:  # for
            vals = F.array(scope[n.value]) if n.value in scope else _values(n.value, vars_col, body)
            sep = _compile(n.alt, vars_col, body, scope)
            parts.append(_join_with(vals, n, vars_col, body, scope, sep))
    if not parts:
        return F.lit("")
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def _join_with(vals: Column, n: Node, vars_col: Column, body: Column, scope: dict, sep: Column) -> Column:
    """Loop body per value, joined by the (evaluated) separator: the separator goes before every item but the first."""
    items = F.transform(vals, lambda x: _compile(n.body, vars_col, body, {**scope, n.value: x}))
    if all(a.kind == "text" for a in n.alt):
        return F.array_join(items, "".join(a.value for a in n.alt))
    return F.aggregate(
        F.transform(items, lambda it, i: F.struct(it.alias("it"), i.alias("i"))), F.lit(""),
        lambda acc, e: F.concat(acc, F.when(e["i"] > 0, sep).otherwise(F.lit("")), e["it"]),
    )


def compile_template(src: str, vars_col: Column, body: Column) -> Column:
    """Template text -> one Column."""
    return _compile(parse_template(src), vars_col, body, {})


def gather_vars(long: DataFrame, key: str = "doc_id") -> DataFrame:
    """``long(doc_id, name, ord, value)`` -> ``(doc_id, vars map<string, array<string>>)``; values keep ``ord``
    order. One shuffle: the map is built in the row from one ordered list per document."""
    entries = F.array_sort(F.collect_list(F.struct("name", "ord", "value")))
    g = long.groupBy(key).agg(entries.alias("e"))
    names = F.array_distinct(F.transform("e", lambda x: x["name"]))
    vals = F.transform(names, lambda nm: F.transform(F.filter("e", lambda x: x["name"] == nm), lambda x: x["value"]))
    return g.select(key, F.map_from_arrays(names, vals).alias("vars"))


def template_render(docs: DataFrame, vars_df: DataFrame, template: str, content: str = "content") -> DataFrame:
    """T1 job: join the gathered variables to the documents and render. Documents without variables render with
    every variable missing."""
    tree_check = parse_template(template)  # fail at job start on a bad template
    del tree_check
    j = docs.join(vars_df, "doc_id", "left")
    v = F.coalesce(F.col("vars"), F.create_map().cast("map<string,array<string>>"))
    return j.select("doc_id", compile_template(template, v, F.col(content)).alias("rendered"))


def includes(content: Column, header: Column, before: Column, after: Column, html: bool, title: Column) -> Column:
    """Fixed texts put in the head, before the body and after the body. For HTML a standalone page is built;
    for text formats the header has no slot and only before/after are added."""
    core = F.concat_ws("\n", F.when(before != "", before), content, F.when(after != "", after))
    if not html:
        return core
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>'),
        F.coalesce(html_escape(title), F.lit("")),
        F.lit("</title>\n"), F.coalesce(header, F.lit("")), F.lit("\n</head>\n<body>\n"), core,
        F.lit("\n</body>\n</html>"),
    )


def merge_metadata(long: DataFrame, title_prefix: str = "") -> DataFrame:
    """``long(doc_id, key, value, priority, ord)`` from several sources (1 = request, 2 = metadata file,
    3 = document). Per (doc_id, key) the source with the smallest priority wins and all its values are kept in
    ``ord`` order; ``title`` values get ``title_prefix + ' - '`` in front. One shuffle on (doc_id, key)."""
    g = long.groupBy("doc_id", "key").agg(
        F.min("priority").alias("p"),
        F.array_sort(F.collect_list(F.struct("priority", "ord", "value"))).alias("e"),
    )
    kept = F.transform(F.filter("e", lambda x: x["priority"] == F.col("p")), lambda x: x["value"])
    if title_prefix:
        kept = F.when(F.col("key") == "title",
                      F.transform(kept, lambda v: F.concat(F.lit(title_prefix + " - "), v))).otherwise(kept)
    return g.select("doc_id", "key", F.col("p").alias("source_priority"), kept.alias("values"))


def metadata_map(merged: DataFrame) -> DataFrame:
    """Merged long metadata -> (doc_id, map<string, array<string>>)."""
    return merged.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("vars"))
