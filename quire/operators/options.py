"""J1 option melt and usage, J2 key/value expansion, J4 resource names.

J1 is a long table for option analytics over a request log (counts per flag and value), not an argument builder:
``(request_id, ord, sub, flag, value)`` in the fixed emit order; false, 0 and '' are dropped, negatives kept;
``to`` is dropped when it is pdf in any case; ``pdf_engine`` defaults to xelatex; maps give one row per entry,
keys ascending; metadata one row per value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.model import MIME_EXT, OPTION_FIELDS, JobConfig, flag_name
from quire.operators.validate import gate_options

_ENTRY = "array<struct<ord:int,sub:int,flag:string,value:string>>"
KV_FIELDS = ("variable", "metadata", "request_header")


def _entry(ord_: int, sub: Column, flag: str, value: Column) -> Column:
    return F.struct(F.lit(ord_).alias("ord"), sub.cast("int").alias("sub"), F.lit(flag).alias("flag"),
                    value.cast("string").alias("value"))


def _map_entries(m: Column, ord_: int, flag: str, multi: bool) -> Column:
    entries = F.array_sort(F.map_entries(m))
    if multi:
        kv = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit("="), v))))
    else:
        kv = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.transform(kv, lambda x, j: _entry(ord_, j + 1, flag, x)), F.array().cast(_ENTRY))


def option_entries(conv: Column, conf: JobConfig = JobConfig(), only: tuple[str, ...] | None = None) -> Column:
    """All emitted option entries of one converter struct, as an array in emit order. Scalar options go into one
    array (NULL for a dropped option, then filtered); the three map options expand into their own arrays."""
    gated_filter, gated_lua = gate_options(conv, conf)
    scalars, maps = [], []
    for ord_, (key, typ) in enumerate(OPTION_FIELDS, start=1):
        if only is not None and key not in only:
            continue
        flag = flag_name(key)
        v = conv[key]
        if key == "filter":
            v = gated_filter
        elif key == "lua_filter":
            v = gated_lua
        if typ == "b":
            scalars.append(F.when(v, _entry(ord_, F.lit(1), flag, F.lit(None))))
        elif typ == "i":
            scalars.append(F.when(F.coalesce(v, F.lit(0)) != 0, _entry(ord_, F.lit(1), flag, v)))
        elif typ in ("s", "f"):
            if key == "pdf_engine":
                v = F.when(F.coalesce(v, F.lit("")) == "", F.lit("xelatex")).otherwise(v)
            keep = F.coalesce(v, F.lit("")) != ""
            if key == "to":
                keep = keep & (F.upper(v) != "PDF")
            scalars.append(F.when(keep, _entry(ord_, F.lit(1), flag, v)))
        else:
            maps.append(_map_entries(v, ord_, flag, typ == "mm"))
    parts = ([F.filter(F.array(*scalars), lambda x: x.isNotNull())] if scalars else []) + maps
    if not parts:
        return F.array().cast(_ENTRY)
    return F.array_sort(F.concat(*parts)) if len(parts) > 1 else parts[0]


def options_long(requests: DataFrame, conf: JobConfig = JobConfig()) -> DataFrame:
    """One row per emitted option of every request that has a converter."""
    r = requests.filter(F.col("converter").isNotNull())
    e = r.select("request_id", option_entries(F.col("converter"), conf).alias("e__"))
    return e.select("request_id", F.inline("e__"))


def option_usage(long: DataFrame) -> DataFrame:
    """J1 analytics: rows and requests per flag."""
    return long.groupBy("flag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("request_id").alias("n_requests")
    )


def option_value_usage(long: DataFrame) -> DataFrame:
    """J1 analytics: requests per (flag, value); booleans count under an empty value."""
    return long.groupBy("flag", F.coalesce("value", F.lit("")).alias("value")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("request_id").alias("n_requests"))


def key_values(requests: DataFrame, fields: tuple[str, ...] = KV_FIELDS) -> DataFrame:
    """Variables and headers as ``k=v`` one per entry, metadata one per value; keys ascending."""
    r = requests.filter(F.col("converter").isNotNull())
    e = r.select("request_id", option_entries(F.col("converter"), only=fields).alias("e__"))
    return e.select("request_id", F.inline("e__")).select(
        "request_id", F.regexp_replace(F.substring("flag", 3, 64), "-", "_").alias("field"),
        F.col("sub").alias("pos"), F.col("value").alias("kv"),
    )


def resource_name(url: Column, content_type: Column) -> Column:
    """Basename of the URL path; the md5 of the URL when there is none; the type's extension appended when the
    name has none (unknown types add nothing)."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    base = F.substring_index(path, "/", -1)
    ext_map = F.create_map(*[F.lit(x) for kv in MIME_EXT.items() for x in kv])
    ext = F.coalesce(F.try_element_at(ext_map, content_type), F.lit(""))
    name = F.when(base == "", F.md5(F.encode(url, "UTF-8"))).otherwise(base)
    return F.when(F.instr(name, ".") > 0, name).otherwise(F.concat(name, ext))
