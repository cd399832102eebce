"""P1 request validation, P2 safe-dir check, P3 option gating. Rows are never dropped.

``validate_requests`` adds ``driver``, ``rule`` (first failing pre-fetch rule, NULL when none), ``message`` and
``conv_error`` (option errors that the reference would hit after the fetch). All rules are one ``coalesce`` of
``when`` expressions: a narrow projection that never touches document text beyond the params JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.codecs import b64_valid, message_col
from quire.model import DATA_PARAMS, ENUMS, HTTP_PARAMS, INT_RANGES, JobConfig
from quire.plans.registry import driver_of
from quire.sources.requests import compute_once

_CORRUPT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
INPUT_FORMATS = ("html", "markdown", "plain")
OUTPUT_FORMATS = ("plain", "markdown", "html")


def normalize_path(p: Column) -> Column:
    """Resolve ``.``, ``..`` and repeated slashes lexically (``..`` never climbs above the root)."""
    empty = F.array().cast("array<string>")
    stack = F.aggregate(
        F.split(p, "/", -1), empty,
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(stack, "/"))


def within_safe_dir(path: Column, root: str, mode: str = "strict") -> Column:
    """P2. ``prefix``: plain string prefix (the reference's check). ``strict``: both sides normalised, then the root
    must be the whole path or a whole-component prefix of it."""
    if mode == "prefix":
        return path.startswith(root)
    if mode != "strict":
        raise ValueError(f"unknown safe-dir mode {mode!r}")
    n = normalize_path(path)
    r = root.rstrip("/") or "/"
    if r == "/":
        return n.startswith("/")
    return (n == r) | n.startswith(r + "/")


def gate_options(converter: Column, conf: JobConfig) -> tuple[Column, Column]:
    """``filter`` / ``lua_filter`` survive only when the job enables them."""
    f = F.when(F.lit(conf.enable_filter), converter["filter"])
    lf = F.when(F.lit(conf.enable_lua_filter), converter["lua_filter"])
    return f, lf


def data_params(params: Column) -> Column:
    return F.from_json(params, DATA_PARAMS + ", _corrupt_record string", _CORRUPT)


def _data_rules(params: Column, p: Column) -> tuple[Column, Column]:
    data = p["data"]
    r7 = params.isNull() | p.isNull() | p["_corrupt_record"].isNotNull() | (data.isNotNull() & ~b64_valid(data))
    r8 = F.when(F.coalesce(data, F.lit("")) == "", message_col("data_empty"))
    return r7, r8


def http_params(params: Column) -> Column:
    return F.from_json(params, HTTP_PARAMS + ", _corrupt_record string", _CORRUPT)


def http_method(p: Column) -> Column:
    m = F.upper(F.coalesce(p["method"], F.lit("")))
    return F.when(m == "", F.lit("GET")).otherwise(m)


def _http_rules(params: Column, p: Column) -> tuple[Column, Column]:
    r7 = params.isNull() | p.isNull() | p["_corrupt_record"].isNotNull()
    m = http_method(p)
    r8 = (
        F.when(F.coalesce(p["url"], F.lit("")) == "", message_col("url_empty"))
        .when(~m.isin("GET", "POST"), message_col("method_unsupported", method=m))
    )
    return r7, r8


def option_errors(conv: Column) -> Column:
    """Conversion-stage errors (rule 12 in our numbering): unsupported formats, unknown enumerated values, and integers
    out of range."""
    out = F.lit(None).cast("string")
    checks = []
    frm, to = F.coalesce(conv["from"], F.lit("")), F.coalesce(conv["to"], F.lit(""))
    checks.append(F.when(~frm.isin(*INPUT_FORMATS), F.concat(F.lit("input format '"), frm, F.lit("' is not supported"))))
    checks.append(F.when(~to.isin(*OUTPUT_FORMATS), F.concat(F.lit("output format '"), to, F.lit("' is not supported"))))
    for key, allowed in ENUMS.items():
        v = conv[key]
        checks.append(
            F.when(v.isNotNull() & (v != "") & ~v.isin(*allowed),
                   F.concat(F.lit("unknown value '"), v, F.lit(f"' for option {key}")))
        )
    for key, (low, high) in INT_RANGES.items():
        checks.append(F.when(~conv[key].between(low, high), F.concat(
            F.lit("value "), conv[key].cast("string"), F.lit(f" for option {key} is not from {low} to {high}"))))
    checks.append(F.when(conv["email_obfuscation"] == "javascript", F.lit("email_obfuscation javascript is not built")))
    out = F.coalesce(*checks)
    return out


def validate_requests(requests: DataFrame, conf: JobConfig = JobConfig()) -> DataFrame:
    """P1 over parsed requests (``quire.sources.requests.parse_requests``)."""
    conv, fet = F.col("converter"), F.col("fetcher")
    dd = conv["data_dir"]
    name = fet["name"]
    drv0 = driver_of(name, conf)
    requests = compute_once(
        requests, driver=drv0,
        dp__=F.when(drv0 == "data", data_params(fet["params"])),
        hp__=F.when(drv0 == "http", http_params(fet["params"])),
    )
    drv = F.col("driver")
    d7, d8 = _data_rules(fet["params"], F.col("dp__"))
    h7, h8 = _http_rules(fet["params"], F.col("hp__"))
    r7 = F.when(drv == "data", d7).when(drv == "http", h7).otherwise(F.lit(False))
    r8 = F.when(drv == "data", d8).when(drv == "http", h8)
    safe = within_safe_dir(dd, conf.safe_dir, conf.safe_dir_mode)
    rule = (
        F.when(F.col("bad_json"), 1).when(conv.isNull(), 2).when(fet.isNull(), 3)
        .when(dd.isNotNull() & (dd != "") & ~safe, 4)
        .when(F.coalesce(name, F.lit("")) == "", 5).when(drv.isNull(), 6).when(r7, 7).when(r8.isNotNull(), 8)
    )
    out = compute_once(requests, rule=rule)
    rule = F.col("rule")
    message = (
        F.when(rule == 1, F.lit("bad_json: request body is not a JSON object"))
        .when(rule == 2, message_col("converter_nil"))
        .when(rule == 3, message_col("fetcher_nil"))
        .when(rule == 4, message_col("data_dir_unsafe", data_dir=dd, safe_dir=conf.safe_dir))
        .when(rule == 5, message_col("no_input"))
        .when(rule == 6, message_col("fetcher_missing", name=name))
        .when(rule == 7, message_col("param_failure"))
        .when(rule == 8, r8)
    )
    return out.withColumn("message", message).withColumn(
        "conv_error", F.when(conv.isNotNull(), option_errors(conv))
    ).drop("dp__", "hp__")
