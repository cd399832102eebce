"""Secret scan by patterns and character Markov models (DataFrame operations only).

Three patterns give the base spans: an assignment to a telling name, an access key id, a long hexadecimal run. Beyond them,
every run of ``TOKEN`` characters is scored by two first-order character Markov models, one of random strings and one of
ordinary identifiers: the log-likelihood ratio per character, and a run that clears ``THRESHOLD`` is a span of kind
``markov`` unless it overlaps a base span.

Both models are trained from labelled samples of the whole corpus: the values that the base patterns find and that hold a
digit are random strings; runs of ``IDENTIFIER`` characters without a digit are ordinary. Counting character pairs is one
aggregate, pre-summed by each task; what comes to the driver is at most 2 * 128 * 128 counts, whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import let, read, sha256_hex, unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the whole run of 20 or more: a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the models score and runs that train the ordinary one; ``ALPHABET`` is the number of their characters.
TOKEN, IDENTIFIER, ALPHABET = r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9+/_=-]{12,}", 66
#: Share of the uniform distribution in the random model; weight, in counts, of the single characters' distribution in the
#: ordinary one and the count added to each of them; the mean log ratio to clear.
UNIFORM, BACKOFF, ADDED, THRESHOLD = 0.5, 33.0, 0.5, 0.5

_SPAN = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"


def _running(lengths: Column, block: int = 256) -> Column:
    """Sums of all elements before each one, block by block, so that long arrays take no square of their length."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))

    def run(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("all")),
                           lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(block))
        state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("all"))
        return F.flatten(F.aggregate(starts, state, lambda s, i: let(
            run(F.slice(v, i, block), s["at"]), lambda r: F.struct(
                r["at"].alias("at"), F.concat(s["all"], F.array(r["all"])).alias("all"))))["all"])

    return let(lengths, lambda v: F.when(F.size(v) == 0, zero["all"]).when(F.size(v) <= block, run(v, F.lit(0).cast("long"))["all"])
               .otherwise(blocks(v)))


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches of a pattern that matches no empty string, with their places."""
    def spans(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
        # a match starts after all gaps up to its own and all matches before it
        return let(_running(F.transform(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))),
                                        lambda x: x["g"] + F.coalesce(F.length(x["m"]), F.lit(0)))), lambda at: let(gaps, lambda gs:
            F.transform(found, lambda m, i: F.struct(
                (F.get(at, i) + F.get(gs, i)).alias("start"),
                (F.get(at, i) + F.get(gs, i) + F.length(m)).alias("end"),
                F.lit(KINDS.index(kind)).alias("kind"), m.alias("value")))))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), 0), spans)).otherwise(
        F.array().cast(_SPAN))


def _named(text: Column) -> Column:
    """Whether a text holds one of the names of ``ASSIGN`` (a quick test before the pattern)."""
    return let(F.lower(text), lambda t: F.exists(F.array(*[F.contains(t, F.lit(x)) for x in NAMES]), lambda x: x))


def base_spans(text: Column) -> Column:
    """The spans of the three patterns (start, end, kind, value) by start, then kind; ``text`` is not null."""
    none = F.array().cast(_SPAN)
    assign = F.when(_named(text), F.filter(_matches(text, ASSIGN, "assign"), lambda x: F.length(
        F.regexp_extract(x["value"], ASSIGN, 2)) >= 6)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, "access")).otherwise(none)
    return F.sort_array(F.concat(assign, access, _matches(text, HEX, "hex")))


def train(df: DataFrame, text: str = "text") -> list[float]:
    """The log ratio of both models for every pair of ASCII characters, at 128 * first + second (0 first: the start).

    Without samples of a kind its model is uniform; an empty table gives ratios of 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    values = F.transform(base_spans(t), lambda x: F.when(
        x["kind"] == 0, F.regexp_extract(x["value"], ASSIGN, 2)).otherwise(x["value"]))
    digit = F.lit("[0-9]")
    samples = F.concat(
        F.transform(F.filter(values, lambda x: F.regexp_like(x, digit)), lambda x: F.struct(F.lit(1).alias("random"), x.alias("s"))),
        F.transform(F.filter(F.regexp_extract_all(t, F.lit(IDENTIFIER), 0), lambda x: ~F.regexp_like(x, digit)),
                    lambda x: F.struct(F.lit(0).alias("random"), x.alias("s"))))
    pairs = df.select(F.inline(samples)).select("random", F.explode(_pairs(F.col("s"))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    rows = {(k, a): sum(n for (r, p), n in counts.items() if r == k and p // 128 == a) for k in (0, 1) for a in range(128)}
    singles = [sum(n for (r, p), n in counts.items() if r == 0 and p % 128 == c) + ADDED for c in range(128)]
    every = sum(rows[0, a] for a in range(128)) + ADDED * ALPHABET
    ratios = []
    for p in range(128 * 128):
        a, c = divmod(p, 128)
        seen = counts.get((1, p), 0) / rows[1, a] if rows[1, a] else 1 / ALPHABET
        random = UNIFORM / ALPHABET + (1 - UNIFORM) * seen
        plain = (counts.get((0, p), 0) + BACKOFF * singles[c] / every) / (rows[0, a] + BACKOFF)
        ratios.append(math.log(random / plain))
    return ratios


def _pairs(s: Column) -> Column:
    """Each character of an ASCII text with the one before it, as 128 * before + it."""
    char = lambda i: F.ascii(F.substring(s, i, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.when(i == 1, F.lit(0)).otherwise(
        char(i - 1) * 128) + char(i))


def secret_spans(df: DataFrame, model: list[float], text: str = "text", spans: str = "spans",
                 threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``spans``: array of (start, end, kind, value), by start, then kind as in ``KINDS``; places in code points.

    A column of that name is replaced; all others stay. A null or empty text has no spans; repeated rows have the same;
    an empty table gives an empty one. Base spans of different kinds may overlap; ``markov`` spans overlap none."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded to a constant
    base, t = unused(df, "_base", "_t")
    df = df.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(base, base_spans(F.col(t)))

    def score(s: Column) -> Column:
        return F.aggregate(_pairs(s), F.lit(0.0), lambda a, p: a + F.get(table, p)) / F.length(s)

    def added(found: Column) -> Column:
        return F.filter(_matches(F.col(t), TOKEN, "markov"), lambda m: (score(m["value"]) >= threshold) & ~F.exists(
            found, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))

    return df.withColumn(spans, F.sort_array(F.concat(F.col(base), added(F.col(base))))).drop(base, t)


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models trained on all ``documents``, then the spans of every whole text."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = secret_spans(docs, train(docs))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), sha256_hex(_listed(base)).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"), n("markov"))
