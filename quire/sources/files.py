"""Side files (``file://`` and scheme-less references) from a file table, only below the safe folder.

The file table is Spark's ``binaryFile`` source (path, length, content); references are resolved by an equi-join on
the normalised path, so each distinct file is read once however many requests point at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.codecs import b64_decode, message_col, utf8, utf8_text
from quire.operators.validate import normalize_path, within_safe_dir


def local_path(ref: Column) -> Column:
    """``file:///a/b``, ``file:/a/b`` and ``/a/b`` -> ``/a/b``; other schemes -> NULL."""
    scheme = F.regexp_extract(ref, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    stripped = F.regexp_replace(ref, r"^file:(//)?", "")
    return F.when(scheme == "", ref).when(F.lower(scheme) == "file", stripped)


def file_table(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    return files.select(normalize_path(local_path(F.col("path"))).alias("f_path"), F.col("content").alias("f_bytes"))


def fetch_files(refs: DataFrame, files: DataFrame, safe_dir: str, mode: str = "strict", ref: str = "ref",
                crawl: DataFrame | None = None, bytes_too: bool = True) -> DataFrame:
    """``refs`` + (data, file_error). Unsafe or missing files are errors; the reference's check applied to all
    file options (D2). A ``data:`` reference is decoded in its row and needs no file. An ``http(s)`` reference is looked up with
    GET in ``crawl`` (url, method, status, body; one row per url, as ``one_per_url`` gives), each distinct url once; any
    status but 200 is an error (D8). ``bytes_too=False`` resolves references without moving contents (``data`` is then empty
    where the reference is fine)."""
    from quire.sources.fetch import DATA_URI_RE

    p = local_path(F.col(ref))
    inline, remote = F.lower(F.col(ref)).startswith("data:"), is_remote(F.col(ref))
    payload = F.when(inline, b64_decode(F.regexp_extract(ref, DATA_URI_RE, 3)))
    safe = within_safe_dir(p, safe_dir, mode)
    r = refs.withColumn("r_path", normalize_path(p)).withColumn("r_safe", F.coalesce(safe, F.lit(False)))
    held = files.select("f_path", (F.col("f_bytes") if bytes_too else F.lit(b"")).alias("f_bytes"))
    j = r.join(held, (F.col("r_path") == F.col("f_path")) & F.col("r_safe"), "left")
    if crawl is None:
        j = j.withColumns({"u_url": F.lit(None).cast("string"), "u_status": F.lit(None).cast("int"), "u_bytes": F.lit(None).cast("binary")})
        unknown = F.lit("unsupported scheme")
    else:
        urls = refs.where(remote).select(F.col(ref).alias("u_url")).distinct()
        got = crawl.where(F.col("method") == "GET").select("url", F.col("status").cast("int").alias("u_status"), utf8(
            F.col("body") if bytes_too else F.lit("")).alias("u_bytes"))
        j = j.join(urls.join(got, F.col("u_url") == F.col("url")).drop("url"), F.when(remote, F.col(ref)) == F.col("u_url"), "left")
        unknown = F.concat(F.lit("fetch url by GET failure <"), F.col(ref), F.lit(">, no snapshot"))
    err = (
        F.when(inline, F.when(~F.col(ref).rlike(DATA_URI_RE) | payload.isNull(), F.lit("not a base64 data uri")))
        .when(remote, F.when(F.col("u_url").isNull(), unknown).when(F.col("u_status") != 200, message_col(
            "fetch_failure", method="GET", url=F.col(ref), status=F.col("u_status").cast("string"))))
        .when(p.isNull(), F.lit("unsupported scheme"))
        .when(~F.col("r_safe"), F.concat(F.lit("file "), F.col(ref), F.lit(" is not in safe dir")))
        .when(F.col("f_path").isNull(), F.concat(F.lit("file "), F.col(ref), F.lit(" not found")))
    )
    return j.withColumn("data", F.when(err.isNull(), F.coalesce(payload, F.col("f_bytes"), F.col("u_bytes")))).withColumn(
        "file_error", err).drop("r_path", "r_safe", "f_path", "f_bytes", "u_url", "u_status", "u_bytes")


def is_remote(ref: Column) -> Column:
    return F.lower(ref).rlike("^https?://")


def file_option_refs(asked: DataFrame) -> DataFrame:
    """``asked(request_id, refs_hash, options)`` -> (request_id, refs_hash, ord, option, ref) for every file-valued option a
    request sets, in emit order."""
    return asked.select("request_id", "refs_hash", F.inline("options"))


def file_options() -> Column:
    """The file-valued options of the request in ``converter``: array of (ord, option, ref), in emit order."""
    from quire.model import OPTION_FIELDS

    conv = F.col("converter")
    return F.filter(F.array(*[
        F.when(F.coalesce(conv[k], F.lit("")) != "", F.struct(F.lit(i).alias("ord"), F.lit(k).alias("option"),
                                                              conv[k].alias("ref")))
        for i, k in enumerate(k for k, t in OPTION_FIELDS if t == "f")]), lambda x: x.isNotNull())


def refs_hash() -> Column:
    """Tells requests of one id with different file options or resource paths apart."""
    return F.xxhash64(file_options(), F.col("converter.resource_path"))


def without_files() -> tuple[Column, Column]:
    """(rule, error) of a request with file options when the job has no file table."""
    from quire.model import FILE_OPTIONS_STRICT

    first = F.get(file_options(), F.lit(0))
    rule = F.when(first["option"].isin(*FILE_OPTIONS_STRICT), F.lit(10)).when(first.isNotNull(), F.lit(11))
    return rule, F.concat(first["option"], F.lit(": file "), first["ref"], F.lit(" not found (the job has no file table)"))


#: Options whose file is a table of its own: it is parsed once per file, and its text does not go to each request.
TABLE_OPTIONS = ("bibliography", "citation_abbreviations")


def source_id(ref: Column) -> Column:
    """What tells the files of table options apart: references to one file have one id."""
    return F.coalesce(normalize_path(local_path(ref)), F.md5(utf8(ref)))


def resolve_file_options(refs: DataFrame, files: DataFrame, safe_dir: str, mode: str = "strict",
                         crawl: DataFrame | None = None) -> DataFrame:
    """Rules 10/11: every file option of a request (``refs``, as ``file_option_refs`` gives) resolved against the file table, below
    the safe folder, or the crawl.

    Returns one row per request id and set of file options (``refs_hash``): ``file_rule`` (10 for the eight options whose failure the
    reference reports, 11 for the six it swallows; both are errors here), ``file_error`` (first failing option in
    emit order), ``file_texts`` (option -> UTF-8 text of each resolved file) and ``file_ids`` (``source_id`` of the files of
    ``TABLE_OPTIONS``, which have no text here)."""
    from quire.model import FILE_OPTIONS_STRICT

    refs = refs.distinct()
    table = F.col("option").isin(*TABLE_OPTIONS)
    got = fetch_files(refs.where(~table), files, safe_dir, mode, crawl=crawl).unionByName(
        fetch_files(refs.where(table), files, safe_dir, mode, crawl=crawl, bytes_too=False))
    errs = F.array_sort(F.collect_list(F.when(F.col("file_error").isNotNull(), F.struct(
        "ord", "option", "file_error"))))
    fine = F.col("data").isNotNull()
    texts = F.collect_list(F.when(fine & ~table, F.struct("option", utf8_text(F.col("data")))))
    ids = F.collect_list(F.when(fine & table, F.struct("option", source_id(F.col("ref")))))
    per = got.groupBy("request_id", "refs_hash").agg(errs.alias("errs"), texts.alias("texts"), ids.alias("ids"))
    first = F.element_at(F.col("errs"), 1)
    return per.select(
        "request_id", "refs_hash",
        F.when(F.size("errs") > 0, F.when(first["option"].isin(*FILE_OPTIONS_STRICT), F.lit(10)).otherwise(F.lit(11)))
        .alias("file_rule"),
        F.when(F.size("errs") > 0, F.concat(first["option"], F.lit(": "), first["file_error"])).alias("file_error"),
        F.map_from_entries("texts").alias("file_texts"), F.map_from_entries("ids").alias("file_ids"),
    )


def table_files(refs: DataFrame, files: DataFrame, safe_dir: str, mode: str = "strict", crawl: DataFrame | None = None) -> DataFrame:
    """(option, source, text): the distinct files that requests name in ``TABLE_OPTIONS`` (``refs``, as ``file_option_refs`` gives),
    each read once."""
    refs = refs.where(F.col("option").isin(*TABLE_OPTIONS)).select("option", "ref").distinct()
    got = fetch_files(refs, files, safe_dir, mode, crawl=crawl).where("data is not null")
    return got.select("option", source_id(F.col("ref")).alias("source"), utf8_text(F.col("data")).alias("text")).groupBy(
        "option", "source").agg(F.min("text").alias("text"))
