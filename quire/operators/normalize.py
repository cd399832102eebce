"""Text normalisation stages (B3, B8-B14) and the corpus job that chains them.

Every stage is a native Column expression on the whole document text; none of them splits a document into rows, so
the job is a narrow projection (no shuffle) until ``normalize_summary`` aggregates.

Definitions (ours; the reference only forwards the options):
* B3 strip_comments: drop ``<!-- ... -->`` including newlines.
* B8 expand_tabs: per line, each tab advances to the next multiple of ``tab_stop`` (unless preserve_tabs).
* B9 eol: ``crlf`` or ``lf``; ``native`` = lf.
* B10 wrap: ``auto`` greedy fill of each line at ``columns`` characters, words never broken; ``none`` joins the lines
  of a paragraph (blank-line separated) with a blank; ``preserve`` keeps the text.
* B11 ascii: every code point above 127 -> ``&#N;``.
* B12 email_obfuscation=references: every character of an e-mail address -> ``&#N;``.
* B13 abbreviations: the blank after a listed abbreviation becomes U+00A0.
* B14 track_changes: accept unwraps ``<ins>`` and deletes ``<del>..</del>``; reject mirrors; all keeps.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.codecs import let
from quire.sources.requests import compute_once

COMMENT_RE = r"(?s)<!--.*?-->"
NON_ASCII_RE = r"[^\x00-\x7F]"
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NBSP = "\u00a0"


def strip_comments(t: Column) -> Column:
    return F.regexp_replace(t, COMMENT_RE, "")


def expand_tabs(t: Column, tab_stop: int | Column = 4) -> Column:
    stop = F.lit(tab_stop) if isinstance(tab_stop, int) else tab_stop

    def line(ln):
        pieces = F.split(ln, "\t", -1)
        head = F.slice(pieces, 1, F.size(pieces) - 1)
        filled = F.aggregate(
            head, F.lit(""),
            lambda acc, p: F.rpad(F.concat(acc, p), (F.floor(F.length(F.concat(acc, p)) / stop) + 1).cast("int")
                                  * stop, F.lit(" ")),
        )
        return F.concat(filled, F.element_at(pieces, -1))

    return let(t, lambda x: F.when(F.instr(x, "\t") > 0, F.array_join(F.transform(F.split(x, "\n", -1), line), "\n"))
               .otherwise(x))


def eol(t: Column, mode: str = "lf") -> Column:
    lf = F.replace(t, F.lit("\r\n"), F.lit("\n"))
    if mode in ("lf", "native"):
        return lf
    if mode == "crlf":
        return F.replace(lf, F.lit("\n"), F.lit("\r\n"))
    raise ValueError(f"unknown eol {mode!r}")


def _fill(line: Column, columns: int) -> Column:
    """Greedy fill of one line: words (split on blanks) go on the current line while it stays within ``columns``
    characters; a longer word stands alone. Done as one bounded regex pass (linear) rather than a fold over the
    words, which would copy the growing line at every step: each match is the longest run of at most ``columns``
    characters that ends at a blank (or a single over-long word)."""
    words = F.regexp_replace(F.trim(line), " +", " ")
    if isinstance(columns, int):
        pattern = F.lit(r"(?s)(.{1," + str(columns) + r"}|[^ ]+)(?: |\z)")
    else:  # per-row width: the pattern is built in the row (compiled once per distinct width)
        pattern = F.concat(F.lit(r"(?s)(.{1,"), columns.cast("string"), F.lit(r"}|[^ ]+)(?: |\z)"))
    broken = F.regexp_replace(words, pattern, F.lit("$1\n"))
    return F.regexp_replace(broken, r"\n\z", "")


def wrap_columns(t: Column, columns: Column | int) -> Column:
    """wrap=auto with a (possibly per-row) width."""
    return F.array_join(F.transform(F.split(t, "\n", -1), lambda ln: _fill(ln, columns)), "\n")


def wrap(t: Column, mode: str = "auto", columns: int = 72) -> Column:
    if mode == "preserve":
        return t
    if mode == "none":
        return F.array_join(F.transform(F.split(t, "\n\n", -1), lambda p: F.replace(p, F.lit("\n"), F.lit(" "))),
                            "\n\n")
    if mode == "auto":
        return F.array_join(F.transform(F.split(t, "\n", -1), lambda ln: _fill(ln, columns)), "\n")
    raise ValueError(f"unknown wrap {mode!r}")


def _char_ref(c: Column) -> Column:
    return F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))


def _zip_tokens(t: Column, pattern: str, fn) -> Column:
    parts = F.split(t, pattern, -1)
    toks = F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), fn)
    return F.array_join(F.zip_with(parts, toks, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")


def ascii_refs(t: Column) -> Column:
    return let(t, lambda x: F.when(x.rlike(NON_ASCII_RE), _zip_tokens(x, NON_ASCII_RE, _char_ref)).otherwise(x))


def email_refs(t: Column) -> Column:
    enc = lambda e: F.array_join(F.transform(F.regexp_extract_all(e, F.lit("."), 0), _char_ref), "")
    return let(t, lambda x: F.when(F.instr(x, "@") > 0, _zip_tokens(x, EMAIL_RE, enc)).otherwise(x))


def abbreviation_pattern(abbreviations: list[str] | tuple[str, ...]) -> str:
    """One alternation of the quoted abbreviations (longest first), matched at a word start and followed by a blank."""
    alts = "|".join(re.escape(a) for a in sorted(set(abbreviations), key=lambda a: (-len(a), a)))
    return r"\b(" + alts + ") "


def abbreviations(t: Column, abbrevs) -> Column:
    """The list is job configuration held on the driver and compiled into the plan as one pattern, whatever its length."""
    return F.regexp_replace(t, abbreviation_pattern(abbrevs), "$1" + NBSP) if abbrevs else t


def track_changes(t: Column, mode: str = "accept") -> Column:
    if mode == "all":
        return t
    drop, unwrap = ("del", "ins") if mode == "accept" else ("ins", "del") if mode == "reject" else (None, None)
    if drop is None:
        raise ValueError(f"unknown track_changes {mode!r}")
    out = F.regexp_replace(t, rf"(?s)<{drop}\b[^>]*>.*?</{drop}\s*>", "")
    return F.regexp_replace(out, rf"</?{unwrap}\b[^>]*>", "")


@dataclass(frozen=True)
class NormalizeOptions:
    track_changes: str = "accept"
    preserve_tabs: bool = False
    tab_stop: int = 4
    abbreviations: tuple[str, ...] = ()
    email_obfuscation: str = "references"
    ascii: bool = True
    wrap: str = "auto"
    columns: int = 72
    eol: str = "lf"
    strip_comments: bool = False


def stages(opts: NormalizeOptions) -> list[tuple[str, callable]]:
    out = []
    if opts.strip_comments:
        out.append(("strip_comments", strip_comments))
    if opts.track_changes != "all":
        out.append(("track_changes", lambda t: track_changes(t, opts.track_changes)))
    if not opts.preserve_tabs:
        out.append(("expand_tabs", lambda t: expand_tabs(t, opts.tab_stop)))
    if opts.abbreviations:
        out.append(("abbreviations", lambda t: abbreviations(t, opts.abbreviations)))
    if opts.email_obfuscation == "references":
        out.append(("email_obfuscation", email_refs))
    elif opts.email_obfuscation not in ("none", ""):
        raise ValueError(f"email_obfuscation {opts.email_obfuscation!r} is not built")
    if opts.ascii:
        out.append(("ascii", ascii_refs))
    if opts.wrap != "preserve":
        out.append(("wrap", lambda t: wrap(t, opts.wrap, opts.columns)))
    out.append(("eol", lambda t: eol(t, opts.eol)))
    return out


def normalize_corpus(docs: DataFrame, opts: NormalizeOptions = NormalizeOptions(), text: str = "content",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, content, changed)``: the stages in order; ``changed`` lists the stages that altered the
    text. Each stage's output is a column of its own, so the next stage and the change test read it instead of
    recomputing it."""
    df = docs.select("doc_id", *keep, F.col(text).alias("s0"))
    names = []
    for k, (name, fn) in enumerate(stages(opts), start=1):
        df = df.withColumn(f"s{k}", fn(F.col(f"s{k - 1}")))
        names.append(name)
    flags = [F.when(F.col(f"s{k}") != F.col(f"s{k - 1}"), F.lit(n)) for k, n in enumerate(names, start=1)]
    changed = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<string>")
    return df.select("doc_id", *keep, F.col(f"s{len(names)}").alias("content"), changed.alias("changed"))


def normalize_summary(normalized: DataFrame, by: str = "source") -> DataFrame:
    """Documents changed per stage and group (partial aggregation before the shuffle). The changes come out of ``compute_once``:
    Catalyst infers a ``size(changed) > 0`` filter for the explode, which would otherwise run every stage a second time, inlined."""
    done = compute_once(normalized.select(by, F.col("changed").alias("c__")), ch__=F.col("c__"))
    return done.select(by, F.explode("ch__").alias("stage")).groupBy(by, "stage").agg(F.count(F.lit(1)).alias("n_docs"))
