"""DuckDB SQL fragments used by the oracle queries (``quire.plans.oracle``).

The oracle is an independent second implementation of each operator definition in DuckDB's dialect (RE2 regexes,
1-based lists, ``lambda x: ...``). Only fixed values (patterns, tables) are shared with the Spark side.
"""

from __future__ import annotations

from quire.functions.codecs import ENTITY_RE, ESCAPES, NAMED_ENTITIES
from quire.operators.blocks import HTML_MARK_RE, HTML_STRIP_RE, TAG_RE

NL2 = "chr(10) || chr(10)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def entity_cp(t: str) -> str:
    b = f"substr({t}, 2, length({t}) - 2)"
    named = f"CASE {b} " + " ".join(f"WHEN '{n}' THEN {cp}" for n, cp in NAMED_ENTITIES.items()) + " END"
    return (
        f"(CASE WHEN substr({b}, 1, 2) IN ('#x', '#X') THEN try_cast('0x' || substr({b}, 3) AS BIGINT) "
        f"WHEN substr({b}, 1, 1) = '#' THEN try_cast(substr({b}, 2) AS BIGINT) ELSE {named} END)"
    )


def entity_dec(t: str) -> str:
    cp = entity_cp(t)
    return (
        f"(CASE WHEN {cp} IS NULL THEN {t} WHEN {cp} > 0 AND {cp} <= 1114111 AND NOT ({cp} BETWEEN 55296 AND 57343) "
        f"THEN chr(CAST({cp} AS INTEGER)) ELSE '\ufffd' END)"
    )


def unescape(src: str, keep: str, col: str, out: str) -> str:
    """Subquery: ``keep`` columns of ``src`` plus ``out`` = ``col`` with character references decoded."""
    re_ = q(ENTITY_RE)
    return f"""(SELECT {keep}, CASE WHEN instr(x__, '&') > 0 THEN array_to_string(list_transform(
        regexp_split_to_array(x__, {re_}), lambda p, i: p || coalesce(toks__[i], '')), '') ELSE x__ END AS {out}
      FROM (SELECT {keep}, {col} AS x__,
                   list_transform(regexp_extract_all({col}, {re_}, 0), lambda t: {entity_dec('t')}) AS toks__
            FROM {src}))"""


def html_escape(x: str) -> str:
    out = x
    for ch, rep in ESCAPES:
        out = f"replace({out}, {q(ch)}, {q(rep)})"
    return out


def html_blocks(src: str) -> str:
    """Block table from ``src(doc_id, content)`` of HTML."""
    prep = (
        f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(content, {q(HTML_STRIP_RE)}, '', 'g'), "
        f"{q(HTML_MARK_RE)}, chr(1) || '\\1' || chr(2), 'g'), {q(TAG_RE)}, ' ', 'g') AS x FROM {src}"
    )
    un = unescape(f"({prep})", "doc_id", "x", "y")
    parts = f"SELECT doc_id, string_split(regexp_replace(y, '[ \\t\\r\\n]+', ' ', 'g'), chr(1)) AS ps FROM {un}"
    exploded = (
        f"SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS block_no, unnest(ps) AS piece FROM ({parts})"
    )
    return f"""(SELECT doc_id, block_no,
        CASE WHEN regexp_full_match(tag, 'h[1-6]') THEN 'heading' WHEN tag = 'li' THEN 'item' ELSE 'para' END AS kind,
        CASE WHEN regexp_full_match(tag, 'h[1-6]') THEN CAST(substr(tag, 2, 1) AS INTEGER) ELSE 0 END AS level,
        trim(substr(piece, instr(piece, chr(2)) + 1)) AS text
      FROM (SELECT *, CASE WHEN block_no > 0 THEN lower(split_part(piece, chr(2), 1)) ELSE '' END AS tag FROM ({exploded}))
      WHERE block_no > 0 OR trim(piece) <> '')"""


def plain_blocks(src: str) -> str:
    return f"""(SELECT doc_id, CAST(generate_subscripts(ls, 1) AS INTEGER) AS block_no, 'para' AS kind,
        0 AS level, unnest(ls) AS text FROM (SELECT doc_id, string_split(content, chr(10)) AS ls FROM {src}))"""


def markdown_blocks(src: str) -> str:
    s = "replace(content, chr(13) || chr(10), chr(10))"
    s = f"regexp_replace({s}, '(?m)^((#{{1,6}}|[-*+]) [^\\n]*)$', chr(1) || '\\1' || chr(1), 'g')"
    s = f"regexp_replace({s}, '\\n([ \\t]*\\n)+', chr(1), 'g')"
    split = f"list_filter(regexp_split_to_array({s}, '\\n?' || chr(1) || '+\\n?'), lambda x: trim(x) <> '')"
    exploded = f"""SELECT doc_id, CAST(generate_subscripts(ps, 1) AS INTEGER) AS block_no, unnest(ps) AS x
        FROM (SELECT doc_id, {split} AS ps FROM {src})"""
    return f"""(SELECT doc_id, block_no,
        CASE WHEN length(h) > 0 THEN 'heading' WHEN regexp_matches(x, '^[-*+] ') THEN 'item' ELSE 'para' END AS kind,
        CAST(length(h) AS INTEGER) AS level,
        trim(CASE WHEN length(h) > 0 THEN substr(x, length(h) + 2) WHEN regexp_matches(x, '^[-*+] ') THEN substr(x, 3)
             ELSE x END) AS text
      FROM (SELECT *, regexp_extract(x, '^(#{{1,6}}) ', 1) AS h FROM ({exploded})))"""


def strip_empty(blocks: str) -> str:
    return f"(SELECT * FROM {blocks} WHERE NOT (kind = 'para' AND trim(text) = ''))"


def plain_piece() -> str:
    return "CASE WHEN kind = 'item' THEN '- ' || text ELSE text END"


def render_plain_agg(blocks: str) -> str:
    """(doc_id, content) from a block table, like B5."""
    return f"""(SELECT doc_id, coalesce(string_agg({plain_piece()}, {NL2} ORDER BY block_no)
        FILTER (WHERE text <> ''), '') AS content FROM {blocks} GROUP BY doc_id)"""


def markdown_piece(atx: bool = True) -> str:
    atx_h = "repeat('#', level) || ' ' || text"
    head = atx_h if atx else (
        f"CASE WHEN level <= 2 THEN text || chr(10) || repeat(CASE WHEN level = 1 THEN '=' ELSE '-' END, "
        f"length(text)) ELSE {atx_h} END"
    )
    return f"CASE WHEN kind = 'heading' THEN {head} WHEN kind = 'item' THEN '- ' || text ELSE text END"


def render_markdown_agg(blocks: str, atx: bool = True) -> str:
    return f"""(SELECT doc_id, coalesce(string_agg({markdown_piece(atx)}, {NL2} ORDER BY block_no)
        FILTER (WHERE text <> ''), '') AS content FROM {blocks} GROUP BY doc_id)"""


def render_html_agg(blocks: str) -> str:
    """(doc_id, content) like B7: lag/lead over the non-empty blocks of a document."""
    esc = html_escape("text")
    return f"""(SELECT doc_id, coalesce(string_agg(piece, chr(10) ORDER BY block_no), '') AS content FROM (
        SELECT doc_id, block_no,
          CASE WHEN kind = 'item' AND coalesce(prev_k, '') <> 'item' THEN '<ul>' || chr(10) ELSE '' END ||
          CASE WHEN kind = 'heading' THEN '<h' || level || '>' || {esc} || '</h' || level || '>'
               WHEN kind = 'item' THEN '<li>' || {esc} || '</li>' ELSE '<p>' || {esc} || '</p>' END ||
          CASE WHEN kind = 'item' AND coalesce(next_k, '') <> 'item' THEN chr(10) || '</ul>' ELSE '' END AS piece
        FROM (SELECT *, lag(kind) OVER w AS prev_k, lead(kind) OVER w AS next_k
              FROM {blocks} WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)))
      GROUP BY doc_id)"""


def b64(x: str) -> str:
    return f"to_base64(encode({x}))"


def b64_valid(x: str) -> str:
    t = f"replace(replace({x}, chr(13), ''), chr(10), '')"
    return f"(length({t}) % 4 = 0 AND regexp_full_match({t}, '[A-Za-z0-9+/]*={{0,2}}'))"


def json_safe(x: str) -> str:
    out = x
    for ch, rep in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"),
                    ("\u2029", "\\u2029")):
        out = f"replace({out}, {q(ch)}, {q(rep)})"
    return out


# --- normalisation stages ------------------------------------------------------------------------------------------

def zip_tokens(src: str, keep: str, col: str, pattern: str, token_fn: str, out: str) -> str:
    """Subquery: ``col`` with every match of ``pattern`` replaced by ``token_fn`` (a lambda body over ``tk``)."""
    pat = q(pattern)
    return f"""(SELECT {keep}, array_to_string(list_transform(regexp_split_to_array(x__, {pat}),
        lambda p, i: p || coalesce(toks__[i], '')), '') AS {out}
      FROM (SELECT {keep}, {col} AS x__, list_transform(regexp_extract_all({col}, {pat}, 0), lambda tk: {token_fn})
            AS toks__ FROM {src}))"""


def char_ref(c: str) -> str:
    return f"('&#' || CAST(unicode({c}) AS VARCHAR) || ';')"


def expand_tabs(t: str, n: int = 4) -> str:
    ps = "string_split(ln, chr(9))"
    line = (f"list_reduce({ps}[1:len({ps}) - 1], lambda acc, p: rpad(acc || p, CAST((length(acc || p) // {n} + 1) "
            f"* {n} AS INTEGER), ' '), '') || {ps}[-1]")
    return (f"(CASE WHEN instr({t}, chr(9)) > 0 THEN array_to_string(list_transform(string_split({t}, chr(10)), "
            f"lambda ln: {line}), chr(10)) ELSE {t} END)")


def eol_crlf(t: str) -> str:
    return f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10))"


def eol_lf(t: str) -> str:
    return f"replace({t}, chr(13) || chr(10), chr(10))"


def wrap_auto(t: str, columns: int = 72) -> str:
    step = (f"CASE WHEN acc.n = 0 THEN {{'out': w, 'n': length(w)}} "
            f"WHEN acc.n + 1 + length(w) <= {columns} THEN {{'out': acc.out || ' ' || w, 'n': acc.n + 1 + length(w)}} "
            f"ELSE {{'out': acc.out || chr(10) || w, 'n': length(w)}} END")
    line = (f"list_reduce(list_filter(string_split(ln, ' '), lambda w: w <> ''), lambda acc, w: {step}, "
            f"{{'out': '', 'n': CAST(0 AS BIGINT)}}).out")
    return f"array_to_string(list_transform(string_split({t}, chr(10)), lambda ln: {line}), chr(10))"


def wrap_none(t: str) -> str:
    return (f"array_to_string(list_transform(string_split({t}, {NL2}), lambda p: replace(p, chr(10), ' ')), "
            f"{NL2})")


def track(t: str, mode: str) -> str:
    drop, unwrap = ("del", "ins") if mode == "accept" else ("ins", "del")
    return (f"regexp_replace(regexp_replace({t}, '(?s)<{drop}\\b[^>]*>.*?</{drop}\\s*>', '', 'g'), "
            f"'</?{unwrap}\\b[^>]*>', '', 'g')")
