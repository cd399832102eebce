"""Media extraction and embedding (M1-M3) and conversion warnings.

M1 pulls ``data:`` URIs out of documents into a resource table with one row per content md5 and content type (keys are
counted before the shuffle, so a picture embedded in a million documents costs one row per task; only one payload per key
travels), and rewrites each URI to ``<dir>/<md5><ext>`` by the split/zip token pattern. A URI whose payload is not base64
stays as it is. M2 is the inverse. M3 resolves references against a file listing along a search path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.codecs import b64_decode, b64_encode
from quire.model import MIME_EXT
from quire.operators.validate import normalize_path, within_safe_dir

INLINE_URI_RE = r"data:([A-Za-z0-9.+-]+/[A-Za-z0-9.+-]+);base64,([A-Za-z0-9+/]+={0,2})"


def _ext(content_type: Column, default_ext: str | Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in MIME_EXT.items() for x in kv])
    fallback = F.lit("." + default_ext.lstrip(".")) if isinstance(default_ext, str) else \
        F.concat(F.lit("."), F.regexp_replace(default_ext, r"^\.", ""))
    return F.coalesce(F.try_element_at(m, content_type), fallback)


def _media_ref(uri: Column, media_dir: str | Column, default_ext: str | Column) -> Column:
    ctype = F.regexp_extract(uri, INLINE_URI_RE, 1)
    data = b64_decode(F.regexp_extract(uri, INLINE_URI_RE, 2))
    folder = F.lit(media_dir.rstrip("/") + "/") if isinstance(media_dir, str) else \
        F.concat(F.regexp_replace(media_dir, "/+$", ""), F.lit("/"))
    return F.concat(folder, F.md5(data), _ext(ctype, default_ext))


def rewrite_media(text: Column, media_dir: str | Column, default_ext: str | Column = "bin") -> Column:
    """M1 in the row: every inline ``data:`` URI of the text becomes ``<dir>/<md5><ext>`` (split / zip, one pass)."""
    uris = F.regexp_extract_all(text, F.lit(INLINE_URI_RE), 0)
    parts = F.split(text, INLINE_URI_RE, -1)
    refs = F.transform(uris, lambda u: F.coalesce(_media_ref(u, media_dir, default_ext), u))
    rewritten = F.array_join(F.zip_with(parts, refs, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    return F.when(F.size(uris) > 0, rewritten).otherwise(text)


def extract_media(docs: DataFrame, media_dir: str = "media", default_ext: str = "bin",
                  content: str = "content") -> tuple[DataFrame, DataFrame]:
    """M1 -> (docs with rewritten content and ``n_media``, resources(md5, content_type, path, data, n_uses)).

    ``doc_id`` identifies a document. Equal bytes under two content types are two resources, as their references differ."""
    c = F.col(content)
    uris = F.filter(F.regexp_extract_all(c, F.lit(INLINE_URI_RE), 0),
                    lambda u: b64_decode(F.regexp_extract(u, INLINE_URI_RE, 2)).isNotNull())
    out = docs.select("*", F.size(uris).alias("n_media"), rewrite_media(c, media_dir, default_ext).alias("c__"))
    out = out.drop(content).withColumnRenamed("c__", content)
    found = docs.select("doc_id", F.posexplode(uris).alias("pos", "uri")).select(
        "doc_id", "pos", F.regexp_extract("uri", INLINE_URI_RE, 1).alias("content_type"),
        b64_decode(F.regexp_extract("uri", INLINE_URI_RE, 2)).alias("data")).withColumn("md5", F.md5("data"))
    # the keys without their bytes first, then the bytes of one use of each
    keys = found.groupBy("md5", "content_type").agg(F.min(F.struct("doc_id", "pos")).alias("use"),
                                                    F.count(F.lit(1)).alias("n_uses"))
    keys = keys.select("n_uses", F.col("use.doc_id").alias("doc_id"), F.col("use.pos").alias("pos"))
    resources = found.join(keys, ["doc_id", "pos"]).select("md5", "content_type", "data", "n_uses", F.concat(
        F.lit(media_dir.rstrip("/") + "/"), F.col("md5"), _ext(F.col("content_type"), default_ext)).alias("path"))
    return out, resources


#: A folder name is taken whole (``++``): giving characters of it back cannot help, since none of them is the ``/`` that follows.
ANY_MEDIA_REF_RE = r"(?:[A-Za-z0-9_.~-]++/)*([0-9a-f]{32})\.[A-Za-z0-9]+"


def self_contained(docs: DataFrame, resources: DataFrame, media_dir: str | None = "media",
                   content: str = "content") -> DataFrame:
    """M2: every ``<dir>/<md5><ext>`` reference found in ``resources`` becomes a ``data:`` URI again
    (``media_dir=None``: a reference in any folder). Unknown references stay as they are. Of resources with equal bytes and
    several content types, the one of the reference's extension is taken, else the smallest type. Rows that share
    ``doc_id`` and content get the same result, others of one ``doc_id`` are kept apart."""
    ref_re = ANY_MEDIA_REF_RE if media_dir is None else media_dir.rstrip("/") + r"/([0-9a-f]{32})\.[A-Za-z0-9]+"
    c = F.col(content)
    docs = docs.withColumn("ch__", F.xxhash64(c))
    refs = docs.select("doc_id", "ch__", F.posexplode(F.regexp_extract_all(c, F.lit(ref_re), 0)).alias("pos", "ref")).distinct()
    refs = refs.withColumn("md5", F.regexp_extract("ref", ref_re, 1))
    # which type each reference takes is settled without the bytes; then one payload per (md5, type) in use is encoded
    types = resources.groupBy("md5").agg(F.array_sort(F.collect_set("content_type")).alias("types"))
    ext = F.regexp_extract("ref", r"(\.[A-Za-z0-9]+)$", 1)
    taken = refs.join(types, "md5").withColumn("content_type", F.coalesce(F.get(F.filter(
        "types", lambda t: _ext(t, "bin") == ext), F.lit(0)), F.get("types", F.lit(0)))).drop("types")
    uri = F.concat(F.lit("data:"), F.col("content_type"), F.lit(";base64,"), b64_encode(F.col("data")))
    resolved = taken.join(resources.select("md5", "content_type", uri.alias("uri")), ["md5", "content_type"]).select(
        "doc_id", "ch__", "pos", "uri")
    per_doc = resolved.groupBy("doc_id", "ch__").agg(F.map_from_entries(F.collect_list(F.struct("pos", "uri"))).alias("reps"))
    d, r = docs.alias("d"), per_doc.alias("r")
    j = d.join(r, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.ch__") == F.col("r.ch__")), "left").select("d.*", "r.reps")
    parts = F.split(c, ref_re, -1)
    found = F.transform(F.regexp_extract_all(c, F.lit(ref_re), 0), lambda ref, i: F.coalesce(F.try_element_at("reps", i), ref))
    merged = F.array_join(F.zip_with(parts, found, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    return j.withColumn(content, F.when(F.col("reps").isNull(), c).otherwise(merged)).drop("reps", "ch__")


def resolve_resources(refs: DataFrame, files: DataFrame, path_list: Column) -> DataFrame:
    """M3: ``refs(doc_id, n, ref)`` x ``:``-separated search path -> first directory holding ``dir/ref`` wins
    (``resolved`` NULL when none). ``files(path)`` is a listing with one row per path. The winner is found as the
    smallest matching position (a hash aggregate on an integer), then rebuilt from the path list."""
    r = refs.withColumn("path_list__", path_list)
    cand = r.select("doc_id", "n", "ref", "path_list__",
                    F.posexplode(F.split("path_list__", ":", -1)).alias("pos", "dir"))
    cand = cand.withColumn("path", F.concat(F.col("dir"), F.lit("/"), F.col("ref")))
    hit = cand.join(files.select("path", F.lit(True).alias("exists")), "path", "left")
    best = hit.groupBy("doc_id", "n", "ref", "path_list__").agg(
        F.min(F.when(F.col("exists"), F.col("pos"))).alias("best"))
    resolved = F.when(F.col("best").isNotNull(), F.concat(
        F.element_at(F.split("path_list__", ":", -1), F.col("best") + 1), F.lit("/"), F.col("ref")))
    return best.select("doc_id", "n", "ref", resolved.alias("resolved"))


#: A relative reference to a resource: a Markdown image, or a src attribute. The first group goes before it.
RESOURCE_RE = r"""(!\[[^\]\n]*\]\(|\bsrc\s*=\s*["'])([^()\s"']+)"""


def _relative(ref: Column) -> Column:
    return ~ref.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|/|#)")


def resource_refs(text: Column) -> Column:
    """The distinct relative resource references of a text, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(RESOURCE_RE), 2), _relative))


def rewrite_refs(text: Column, paths: Column) -> Column:
    """Each relative resource reference in ``paths`` (map reference -> path) is replaced; others stay."""
    refs = F.regexp_extract_all(text, F.lit(RESOURCE_RE), 2)
    tags = F.regexp_extract_all(text, F.lit(RESOURCE_RE), 1)
    put = F.zip_with(tags, refs, lambda tag, ref: F.concat(tag, F.when(_relative(ref), F.coalesce(F.try_element_at(paths, ref), ref)).otherwise(ref)))
    return F.array_join(F.zip_with(F.split(text, RESOURCE_RE, -1), put, lambda part, x: F.concat(part, F.coalesce(x, F.lit("")))), "")


def resource_paths(refs: DataFrame, files: DataFrame, safe_dir: str, mode: str = "strict") -> DataFrame:
    """M3 for a job: ``refs(request_id, refs_hash, ref, resource_path)`` -> (request_id, refs_hash, paths map<ref, path>). The
    first directory of the ``:``-separated resource path that holds the reference wins; only files below the safe folder
    count. ``files(f_path)`` has one row per normalised path; no text and no content takes part."""
    tried = refs.select("request_id", "refs_hash", "ref", F.posexplode(F.split("resource_path", ":", -1)).alias("pos", "dir"))
    tried = tried.withColumn("path", F.concat(F.regexp_replace("dir", "/+$", ""), F.lit("/"), F.col("ref"))).where(F.col("dir") != "")
    tried = tried.withColumn("n_path", normalize_path(F.col("path"))).where(within_safe_dir(F.col("path"), safe_dir, mode))
    # both sides grow with the requests, and Spark takes the exploded one for as small as the file that it is read from: no broadcast
    best = tried.hint("merge").join(files.select("f_path"), F.col("n_path") == F.col("f_path")).groupBy("request_id", "refs_hash", "ref").agg(
        F.min(F.struct("pos", "path")).alias("b"))
    return best.groupBy("request_id", "refs_hash").agg(F.map_from_entries(F.collect_list(F.struct("ref", "b.path"))).alias("paths"))


def warnings(*parts: DataFrame) -> DataFrame:
    """Union of ``(doc_id, kind, detail)`` warning tables."""
    out = parts[0].select("doc_id", "kind", "detail")
    for p in parts[1:]:
        out = out.unionByName(p.select("doc_id", "kind", "detail"))
    return out


def html_warnings(docs: DataFrame, content: str = "content") -> DataFrame:
    """HTML without a closing body, and text that is not valid UTF-8."""
    c = F.col(content)
    unclosed = docs.filter(~F.lower(c).contains("</body>")).select(
        "doc_id", F.lit("html_unclosed").alias("kind"), F.lit("no </body>").alias("detail"))
    bad = docs.filter(~F.is_valid_utf8(c)).select(
        "doc_id", F.lit("invalid_utf8").alias("kind"), F.lit("text is not valid UTF-8").alias("detail"))
    return unclosed.unionByName(bad)


def fail_if_warnings(w: DataFrame, enabled: bool) -> DataFrame:
    """The job raises when warnings exist and the option is on (one tiny action: ``limit(1)``)."""
    if enabled and w.limit(1).count() > 0:
        raise RuntimeError("conversion produced warnings and fail_if_warnings is set")
    return w
