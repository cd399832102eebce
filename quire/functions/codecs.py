"""Per-row codecs as native Column expressions (no Python UDF).

These are the building blocks of the corpus jobs in ``quire.functions.jobs`` and are reused inside the content
operators (block splitting decodes entities, HTML rendering escapes text, results are base64 in JSON).
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named character references we decode (name -> code point). Everything else that looks like a
# named reference is kept as it is.
NAMED_ENTITIES = {
    "amp": 0x26, "lt": 0x3C, "gt": 0x3E, "quot": 0x22, "apos": 0x27, "nbsp": 0xA0, "copy": 0xA9, "middot": 0xB7,
    "reg": 0xAE, "trade": 0x2122, "hellip": 0x2026, "mdash": 0x2014, "ndash": 0x2013, "lsquo": 0x2018,
    "rsquo": 0x2019, "ldquo": 0x201C, "rdquo": 0x201D, "euro": 0x20AC,
}

# A character reference: decimal, hex or named, always closed by ';'.
ENTITY_RE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

# HTML escaping, '&' first so that nothing is escaped twice.
ESCAPES = [("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")]

# Characters JSON output writes as \\u escapes (HTML-safe JSON).
JSON_SAFE = [("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")]

B64_RE = r"^[A-Za-z0-9+/]*={0,2}$"
#: The letters one by one: the regex engine then looks a character up in one table, where ranges cost a call each.
B64_WHOLE_RE = r"\A[" + string.ascii_letters + string.digits + r"+/]*={0,2}\z"


def utf8(c: Column) -> Column:
    """String -> UTF-8 bytes."""
    return F.encode(c, "UTF-8")


def message_col(key: str, **values) -> Column:
    """A fixed message (``quire.model.MESSAGES``) with its ``{name}`` slots filled by columns or literals."""
    import re

    from quire.model import MESSAGES

    parts = []
    for piece in re.split(r"(\{\w+\})", MESSAGES[key]):
        if not piece:
            continue
        slot = re.fullmatch(r"\{(\w+)\}", piece)
        if slot:
            v = values[slot.group(1)]
            parts.append(v if isinstance(v, Column) else F.lit(str(v)))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def utf8_text(b: Column) -> Column:
    """UTF-8 bytes -> string; malformed sequences become U+FFFD instead of failing the job (``decode`` raises on
    malformed input). Pair with ``utf8_valid`` to report them."""
    return F.make_valid_utf8(b.cast("string"))


def utf8_valid(b: Column) -> Column:
    return F.is_valid_utf8(b.cast("string"))


def one_line(s: Column) -> Column:
    """``s`` without CR and LF (``translate`` would build a string per character, which was most of a conversion job's time)."""
    return F.replace(F.replace(s, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))


def b64_encode(b: Column) -> Column:
    """Standard padded base64 on one line. Spark's base64() may break lines every 76 characters (a setting): then there is a
    break after the first 76, and only then the text is searched for breaks."""
    return let(F.base64(b), lambda t: F.when(F.substring(t, 77, 1) == "\r", one_line(t)).otherwise(t))


def b64_whole(s: Column) -> Column:
    """True when ``s`` is strict standard base64 without CR and LF (all ASCII then, so bytes are characters)."""
    return (F.octet_length(s) % 4 == 0) & s.rlike(B64_WHOLE_RE)


def b64_valid(s: Column) -> Column:
    """True when ``s`` is strict standard base64 (padding required); CR and LF are ignored."""
    t = one_line(s)
    return b64_whole(s) | ((F.length(t) % 4 == 0) & t.rlike(B64_RE))


def b64_decode(s: Column) -> Column:
    """Strict standard base64 -> bytes, NULL when invalid; CR and LF are ignored. ``unbase64`` skips what is not base64, and
    ``b64_whole`` lets nothing of that through."""
    return let(s, lambda x: F.when(b64_whole(x), F.unbase64(x)).otherwise(
        let(one_line(x), lambda t: F.when(b64_whole(t), F.unbase64(t)))))


def html_escape(s: Column) -> Column:
    out = s
    for ch, rep in ESCAPES:
        out = F.replace(out, F.lit(ch), F.lit(rep))
    return out


def json_html_safe(s: Column) -> Column:
    out = s
    for ch, rep in JSON_SAFE:
        out = F.replace(out, F.lit(ch), F.lit(rep))
    return out


def codepoint_char(cp: Column) -> Column:
    """Code point -> one-character string; invalid code points give U+FFFD."""
    valid = (cp > 0) & (cp <= 0x10FFFF) & ~cp.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))


def entity_codepoint(tok: Column) -> Column:
    """Code point of a character reference token (``&...;``), NULL for an unknown name."""
    body = F.substring_index(F.substring(tok, 2, 1 << 20), ";", 1)
    named = F.lit(None).cast("bigint")
    for name, cp in reversed(list(NAMED_ENTITIES.items())):
        named = F.when(body == name, F.lit(cp)).otherwise(named)
    is_hex = body.startswith("#x") | body.startswith("#X")
    return (
        F.when(is_hex, F.conv(F.substring(body, 3, 16), 16, 10).cast("bigint"))
        .when(body.startswith("#"), F.substring(body, 2, 16).cast("bigint"))
        .otherwise(named)
    )


def decode_entity(tok: Column) -> Column:
    cp = entity_codepoint(tok)
    return F.when(cp.isNull(), tok).otherwise(codepoint_char(cp))


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it many times in ``fn`` (a one-element ``transform``). Keeps an expensive
    intermediate (a whole cleaned document) from being recomputed where subexpression elimination does not reach
    (filters, generators, lambda bodies)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def html_unescape(s: Column) -> Column:
    """Decode character references in one pass: split around the references and zip the decoded tokens back in."""

    def body(x):
        toks = F.regexp_extract_all(x, F.lit(ENTITY_RE), 0)
        parts = F.split(x, ENTITY_RE, -1)
        merged = F.zip_with(parts, F.transform(toks, decode_entity), lambda p, d: F.concat(p, F.coalesce(d, F.lit(""))))
        return F.when(F.instr(x, "&") > 0, F.array_join(merged, "")).otherwise(x)

    return let(s, body)


def collapse_blanks(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def md5_text(s: Column) -> Column:
    return F.md5(utf8(s))
