"""Line-first quality cleaning (DataFrame operations only, no shuffle).

Every line of a document is judged by three rules; failing lines are removed; a document that loses too much of its text
with them is rejected, and so is one that fails the base rules on the whole text.

- punctuation: of the line's characters outside white space, more than ``max_marks`` are symbols, or more than
  ``max_shout`` of its words end in two exclamation marks (shouted or garbled text);
- navigation: a bar, bullet or guillemet stands between words at least once per ``words_per_bar`` words (menus, tables);
- boilerplate: the line holds one of ``BOILERPLATE`` (licences, cookie and copyright notices).

Lines without a word neither fail nor count. Whatever the function of an array element needs from its whole row is bound
with ``let``, so that it is computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import blank_words, let, read, unused

SYMBOLS = "#*$%&|<>"
MARKS = SYMBOLS + "~^=_{}[]\\@+"
BARS = "|•»›·"
BOILERPLATE = ("licensed under", "all rights reserved", "terms of use", "terms of service", "privacy policy",
               "cookie policy", "use cookies", "copyright ©", "copyright (c)", "subscribe to our", "click here",
               "enable javascript", "powered by", "lorem ipsum")


WORD = r"[^\x20\x09-\x0D]"


def _class(chars: str) -> str:
    """A character class of these characters, for a regular expression."""
    return "[" + "".join("\\" + c if c in "\\[]^&" else c for c in chars) + "]+"


def _count(c: Column, chars: str) -> Column:
    """How many characters of ``c`` are among ``chars``."""
    return F.length(c) - F.length(F.regexp_replace(c, _class(chars), ""))


def line_ok(line: Column, max_marks: float = 0.15, max_shout: float = 0.3, words_per_bar: int = 4) -> Column:
    """Whether a line passes the three rules; blanks (U+0020) part its words."""
    solid = F.length(F.replace(line, F.lit(" "), F.lit("")))
    words = F.length(line) - solid + 1
    bars = F.when(F.regexp_like(line, F.lit(_class(BARS))), _count(line, BARS)).otherwise(0)
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
    low = F.lower(line)
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | F.contains(low, F.lit(phrase))
    bad = ((_count(line, MARKS) > solid * max_marks) | (shouts > words * max_shout)
           | ((bars > 0) & (bars * words_per_bar >= words)) | boiler)
    return ~bad


def n_repeat_words(words: Column) -> Column:
    """Words inside any window of five words that comes twice or more in the text (long)."""
    def covered(at: Column) -> Column:  # the places of repeated windows, ascending
        return F.aggregate(F.transform(at, lambda x, i: F.when(
            i < F.size(at) - 1, F.least(F.get(at, i + 1) - x, F.lit(5))).otherwise(5)),
            F.lit(0).cast("long"), lambda a, x: a + x)

    def repeats(s: Column) -> Column:  # (hash, place) sorted: the places of those equal to a neighbour
        return F.sort_array(F.transform(F.filter(s, lambda x, i:
            ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["g"] == x["g"]))),
            lambda x: x["i"]))

    def windows(w: Column) -> Column:
        return F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.size(w) - 4),
                                                  lambda i: F.xxhash64(F.slice(w, i, 5))))

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda w: let(windows(w), lambda g: F.when(
        g.isNotNull() & (F.size(F.array_distinct(g)) < F.size(g)),
        let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))),
            lambda s: let(repeats(s), covered))).otherwise(F.lit(0).cast("long"))))


def quality_rules(df: DataFrame, text: str = "text", max_lost: float = 0.5, **rules) -> DataFrame:
    """Adds to every row the base counts, the rules' outcome and the cleaned text.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); base_failed; n_lines and
    n_bad_lines (lines with a word, and those that fail); lost_share (characters of the failing lines to those of all
    lines with a word; 0 without any); kept (not base_failed and lost_share <= ``max_lost``); clean_text (the text without
    its failing lines). Columns of these names are replaced; the others stay. A null text has no words, fails the base
    rules and has a null clean_text; an empty text likewise with an empty one. An empty table gives an empty one.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines",
             "n_bad_lines", "lost_share", "kept", "clean_text"]
    df = df.drop(*[c for c in added if c != text])
    keep = [F.col(f"`{c}`") for c in df.columns]
    t, w, ok, ln, lost, whole = unused(df, "_t", "_w", "_ok", "_ln", "_lost", "_all")
    has_word = lambda x: F.regexp_like(x, F.lit(WORD))
    df = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({w: blank_words(F.col(t)), ln: F.split(F.col(t), "\n", -1)})
    df = df.withColumns({
        "n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_repeat_words": n_repeat_words(F.col(w)), "n_symbols": _count(F.col(t), SYMBOLS).cast("long"),
        ok: F.transform(ln, lambda x: F.struct(x.alias("line"), has_word(x).alias("word"),
                                               (~has_word(x) | line_ok(x, **rules)).alias("ok")))})
    total = lambda c: F.aggregate(F.filter(F.col(ok), c), F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"]))
    worded = F.transform(F.filter(F.col(ok), lambda x: x["word"]), lambda x: x["line"])
    df = df.withColumns({
        "n_dup_lines": let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(worded).cast("long"),
        "n_bad_lines": F.size(F.filter(F.col(ok), lambda x: ~x["ok"])).cast("long"),
        lost: total(lambda x: ~x["ok"]), whole: total(lambda x: x["word"]),
        "clean_text": F.when(F.col(text).isNotNull(), F.array_join(F.transform(
            F.filter(F.col(ok), lambda x: x["ok"]), lambda x: x["line"]), "\n")),
        "base_failed": (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)})
    df = df.withColumn("lost_share", F.when(F.col(whole) > 0, F.col(lost) / F.col(whole)).otherwise(F.lit(0.0)))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost))
    return df.select(*keep, *added)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts, the outcome and the removed lines of every whole text of ``documents``."""
    return quality_rules(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_bad_lines", F.length("clean_text").cast("long").alias("clean_chars"))


def _sql() -> str:
    boiler = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
    return rf"""
WITH d AS (SELECT doc_id, text, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (
      SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, i, ls[i] AS l FROM (
    SELECT doc_id, string_split(t, chr(10)) AS ls, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
m AS (SELECT *, regexp_matches(l, '{WORD}') AS word, length(replace(l, ' ', '')) AS solid,
    length(l) - length(regexp_replace(l, '{_class(MARKS)}', '', 'g')) AS marks,
    length(l) - length(regexp_replace(l, '{_class(BARS)}', '', 'g')) AS bars, length(l) - length(replace(l, '!!', '!')) AS shouts,
    lower(l) AS low FROM l),
b AS (SELECT *, word AND (marks > solid * 0.15::DOUBLE OR shouts > (length(l) - solid + 1) * 0.3::DOUBLE
    OR (bars > 0 AND bars * 4 >= length(l) - solid + 1) OR {boiler}) AS bad FROM m),
s AS (SELECT doc_id, count(*) FILTER (word) AS n_lines, count(DISTINCT l) FILTER (word) AS n_diff,
    count(*) FILTER (bad) AS n_bad, coalesce(sum(length(l)) FILTER (bad), 0) AS lost,
    coalesce(sum(length(l)) FILTER (word), 0) AS whole,
    coalesce(sum(length(l) + 1) FILTER (NOT bad) - 1, 0) AS clean FROM b GROUP BY doc_id),
o AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(rep.n, 0) AS n_repeat_words, text
  FROM d LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_lines - n_diff AS n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (whole = 0 OR lost <= 0.5 * whole) AS kept,
  n_lines, n_bad AS n_bad_lines, CASE WHEN text IS NOT NULL THEN clean::BIGINT END AS clean_chars
FROM o JOIN s USING (doc_id)
"""


SQL = _sql()
