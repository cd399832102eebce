"""Outcome rows and their renderings.

An outcome is ``(code int, message string, result struct<data:binary>)``: code 0 with data, or 400 with a message
and no result. Failed requests are never dropped; they flow through as outcome rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.codecs import b64_encode, html_escape, json_html_safe

OK, BAD_REQUEST = 0, 400


def envelope(error: Column, data: Column) -> Column:
    """``error`` is NULL for success. Success -> (0, '', {data}); failure -> (400, error, NULL)."""
    ok = error.isNull()
    return F.struct(
        F.when(ok, F.lit(OK)).otherwise(F.lit(BAD_REQUEST)).alias("code"),
        F.coalesce(error, F.lit("")).alias("message"),
        F.when(ok, F.struct(data.alias("data"))).alias("result"),
    )


def render_default(outcome: Column) -> Column:
    """``{"code":..,"message":".."[,"result":{"data":"<base64>"}]}``; the result key only when present.
    Unlike the reference, the message is always escaped, so the output is valid JSON."""
    return F.to_json(F.struct(outcome["code"].alias("code"), outcome["message"].alias("message"),
                              outcome["result"].alias("result")))


def render_embed(outcome: Column, to: Column) -> Column:
    """HTML page. Code 0 and ``to`` exactly ``pdf``: an ``<embed>`` of the base64 data; code 0 otherwise: an
    empty body; failure: the (escaped) message."""
    ok = outcome["code"] == OK
    embed = F.concat(
        F.lit('<embed src="data:application/pdf;base64,'), b64_encode(outcome["result"]["data"]),
        F.lit('" type="application/pdf" width="100%" height="100%"/>'),
    )
    inner = F.when(ok & (to == "pdf"), embed).when(ok, F.lit("")).otherwise(html_escape(outcome["message"]))
    return F.concat(F.lit("<html>\n<body>\n"), inner, F.lit("\n</body>\n</html>"))


def render_binary(outcome: Column, to: Column) -> Column:
    """(status, content_type, body). pdf -> application/pdf; failure -> 400 and the message bytes."""
    ok = outcome["code"] == OK
    return F.struct(
        F.when(ok, F.lit(200)).otherwise(F.lit(400)).alias("status"),
        F.when(ok & (to == "pdf"), F.lit("application/pdf")).alias("content_type"),
        F.when(ok, outcome["result"]["data"]).otherwise(F.encode(outcome["message"], "UTF-8")).alias("body"),
    )


def render_json_go(value: Column) -> Column:
    """JSON as Go writes it for HTML use: ``<``, ``>``, ``&`` (and U+2028/9) as \\u escapes."""
    return json_html_safe(F.to_json(value))


def outcome_summary(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Counts by the given keys (partial aggregation before the shuffle)."""
    return outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
