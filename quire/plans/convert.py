"""The conversion job (E1), its deduplicating form (E2) and the sink.

E1: parse -> validate -> fetch (routed joins) -> blocks -> content operators -> render -> envelope -> response.
One outcome row per request, failures included. Options are per-row data: each option picks a branch of a ``CASE``
so only the chosen operator runs for a row, and no distinct option sets are collected to the driver. The parsed
block array is computed once per row (generator barrier) and then read by every option branch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.codecs import html_escape, let, md5_text, utf8, utf8_text, utf8_valid
from quire.model import CONVERTER_SCHEMA, JobConfig
from quire.operators import blocks as B
from quire.operators import inrow as I
from quire.operators import links as L
from quire.operators import media as M
from quire.operators import normalize as N
from quire.operators import render as R
from quire.plans import registry
from quire.operators.results import envelope, render_binary, render_default, render_embed
from quire.operators.options import option_entries
from quire.operators.metadata import ENTRIES, document_metadata, without_head
from quire.operators.rowtemplate import render_row
from quire.operators.templates import compile_template, includes, parse_template
from quire.operators.validate import validate_requests
from quire.sources.fetch import dispatch_fetch, one_per_url
from quire.sources.files import file_option_refs, file_options, refs_hash, resolve_file_options, table_files, without_files
from quire.session import scratch_path
from quire.sources.requests import compute_once

DEFAULT_TEMPLATE = "default"
#: Rows of two ids that may be broadcast: about 20 MB.
BROADCAST_ROWS = 1_000_000


def shift_block_levels(blocks: Column, base: Column) -> Column:
    """O1 in-row (the same rule as ``outline.shift_headings``)."""
    def one(b):
        new = F.greatest(b["level"] + base - 1, F.lit(1))
        demote = (b["kind"] == "heading") & (new > 6)
        return F.struct(
            b["block_no"].alias("block_no"),
            F.when(demote, F.lit("para")).otherwise(b["kind"]).alias("kind"),
            F.when(demote, F.lit(0)).when(b["kind"] == "heading", new).otherwise(b["level"]).cast("int").alias("level"),
            b["text"].alias("text"),
        )
    return F.transform(blocks, one)


def parse_blocks(content: Column, frm: Column) -> Column:
    return (
        F.when(frm == "html", B.html_block_array(content))
        .when(frm == "markdown", B.markdown_block_array(content))
        .otherwise(B.plain_block_array(content))
    )


def _opt(conv, key: str, default):
    """An option with its default: a Python value when the options are fixed for the job (``dict``), else a Column
    read from the per-row converter struct."""
    if isinstance(conv, dict):
        v = conv.get(key)
        return default if v is None else v
    return F.coalesce(conv[key], F.lit(default))


def _test(v, op: str, ref):
    """A condition on an option: a Python bool for job-level options, a Column for per-row ones."""
    if op == "in":
        return v.isin(*ref) if isinstance(v, Column) else v in ref
    if op == "==":
        return v == ref
    if op == "!=":
        return v != ref
    if op == ">":
        return v > ref
    raise ValueError(op)


def _and(a, b):
    if isinstance(a, Column) or isinstance(b, Column):
        return (a if isinstance(a, Column) else F.lit(a)) & (b if isinstance(b, Column) else F.lit(b))
    return a and b


def _or(a, b):
    if isinstance(a, Column) or isinstance(b, Column):
        return (a if isinstance(a, Column) else F.lit(a)) | (b if isinstance(b, Column) else F.lit(b))
    return a or b


def _not(a):
    return ~a if isinstance(a, Column) else not a


def _pick(cond, yes, no):
    if isinstance(cond, Column):
        return F.when(cond, yes).otherwise(no)
    return yes if cond else no


def converter_struct(**options) -> Column:
    """A full converter struct (all option fields) with the given options set and the rest unset."""
    return F.struct(*[
        (F.lit(options[f.name]) if f.name in options else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CONVERTER_SCHEMA.fields
    ])


def file_text(files_col: Column | None, option: str) -> Column | None:
    return None if files_col is None else F.try_element_at(files_col, F.lit(option))


def abbreviation_regex(lines_text: Column) -> Column:
    """Per-row pattern from an abbreviations file (one per line): every metacharacter escaped, longest first."""
    lines = F.filter(F.transform(F.split(lines_text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    ordered = F.array_sort(lines, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(
        F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    alts = F.array_join(F.transform(ordered, lambda x: F.regexp_replace(x, r"([\\\[\](){}.*+?^$|])", r"\\$1")), "|")
    return F.concat(F.lit("\\b("), alts, F.lit(") "))


class Chain:
    """A value carried through option stages.

    Column mode (no ``df``): stages compose expressions; job-level conditions resolve while the plan is built, and a
    per-row condition binds its input once (``let``), so stacked stages keep the plan linear. Frame mode: the stages
    of a group are collected and ``flush`` turns them into one projection of the column ``name`` of ``df``:
    ``CASE WHEN <any stage of the group is on for the row> THEN <the bound chain> ELSE <the column> END``. A row with
    no option of the group set takes the cheap branch, and one projection per group keeps plan analysis small."""

    def __init__(self, value: Column | None = None, df: DataFrame | None = None, name: str | None = None):
        self.df, self.name, self._value = df, name, value
        self._pending: list = []
        if df is not None and value is not None:
            self.df = df.withColumn(name, value)

    @property
    def value(self) -> Column:
        return F.col(self.name) if self.df is not None else self._value

    def set(self, expr: Column) -> "Chain":
        if self.df is not None:
            self.flush()
            self.df = self.df.withColumn(self.name, expr)
        else:
            self._value = expr
        return self

    def stage(self, cond, fn) -> "Chain":
        if self.df is not None:
            if isinstance(cond, Column) or cond:
                self._pending.append((cond if isinstance(cond, Column) else None, fn))
            return self
        if not isinstance(cond, Column):
            if cond:
                self._value = fn(self._value)
            return self
        self._value = let(self._value, lambda y: F.when(cond, fn(y)).otherwise(y))
        return self

    def flush(self) -> "Chain":
        if self.df is None or not self._pending:
            return self
        x = F.col(self.name)
        composed, active = x, None
        for cond, fn in self._pending:
            if cond is None:
                composed, active = fn(composed), F.lit(True)
            else:
                composed = let(composed, _guarded(cond, fn))
                active = cond if active is None else (active | cond)
        self._pending = []
        self.df = self.df.withColumn(self.name, F.when(active, composed).otherwise(x))
        return self


def _guarded(cond: Column, fn):
    """``y -> fn(y) where cond, else y`` as a one-argument function (PySpark reads the arity of lambdas)."""
    return lambda y: F.when(cond, fn(y)).otherwise(y)


def _chain(x) -> Chain:
    return x if isinstance(x, Chain) else Chain(value=x)


def prepare_input(content, frm, conv, files_col: Column | None = None):
    """Options that act on the source text before it is split: strip_comments, track_changes, tab expansion
    (markdown and plain input, unless preserve_tabs; tab_stop default 4), abbreviations (from a resolved file).
    Takes and returns a Column, or a ``Chain`` (then its stages are applied in place)."""
    c = _chain(content)
    c.stage(_opt(conv, "strip_comments", False), N.strip_comments)
    track = _opt(conv, "track_changes", "")
    c.stage(_test(track, "==", "accept"), lambda y: N.track_changes(y, "accept"))
    c.stage(_test(track, "==", "reject"), lambda y: N.track_changes(y, "reject"))
    tabs = _and(_test(frm, "!=", "html"), _not(_opt(conv, "preserve_tabs", False)))
    if c.df is not None and isinstance(tabs, Column):  # on only when the row has a tab (stages never add one)
        tabs = tabs & (F.instr(F.col(c.name), "\t") > 0)
    stop_v = _opt(conv, "tab_stop", 0)
    stop = _pick(_test(stop_v, ">", 0), stop_v, 4)
    c.stage(tabs, lambda y: N.expand_tabs(y, stop))
    abbr = file_text(files_col, "abbreviations")
    if abbr is not None:
        c.stage(abbr.isNotNull() & (F.size(F.filter(F.split(abbr, "\n", -1), lambda x: F.trim(x) != "")) > 0),
                lambda y: F.regexp_replace(y, abbreviation_regex(abbr), F.lit("$1" + N.NBSP)))
    return c.flush() if isinstance(content, Chain) else c.value


def page_parts(conv, files_col: Column | None) -> tuple[Column, Column, Column]:
    """(header, before, after) of a standalone page: css link and include_in_header / include_before_body /
    include_after_body files (T2)."""
    css = _opt(conv, "css", "")
    css = css if isinstance(css, Column) else F.lit(css)
    link = F.when(css != "", F.concat(F.lit('<link rel="stylesheet" href="'), html_escape(css), F.lit('">')))
    inc = [file_text(files_col, k) for k in ("include_in_header", "include_before_body", "include_after_body")]
    header = F.concat_ws("\n", link, inc[0]) if inc[0] is not None else F.coalesce(link, F.lit(""))
    return header, F.coalesce(inc[1], F.lit("")) if inc[1] is not None else F.lit(""), \
        F.coalesce(inc[2], F.lit("")) if inc[2] is not None else F.lit("")


def apply_block_options(blocks, conv):
    """Block options: strip_empty_paragraphs, base_header_level, number_sections + number_offset, toc + toc_depth.
    Takes and returns a Column, or a ``Chain`` (stages applied in place)."""
    c = _chain(blocks)
    base = _opt(conv, "base_header_level", 0)
    c.stage(_opt(conv, "strip_empty_paragraphs", False), B.drop_empty_paras)
    c.stage(_test(base, "!=", 0), lambda y: shift_block_levels(y, base if isinstance(base, Column) else F.lit(base)))
    offset = _opt(conv, "number_offset", 0)
    c.stage(_opt(conv, "number_sections", False),
            lambda y: I.number_headings(y, offset if isinstance(offset, Column) else F.lit(offset)))
    depth_v = _opt(conv, "toc_depth", 0)
    depth = _pick(_test(depth_v, ">", 0), depth_v, 3)
    c.stage(_opt(conv, "toc", False), lambda y: I.with_toc(y, depth if isinstance(depth, Column) else F.lit(depth)))
    return c.flush() if isinstance(blocks, Chain) else c.value


def write_text(x: Column, to, conv, files_col: Column | None = None, links: Column | None = None,
               standalone=None) -> Column:
    """The writer for ``to``: plain; markdown (atx_headers; wrap + columns on paragraphs; reference_links notes per
    reference_location when ``links`` is given); html (id_prefix, section_divs, standalone page with css and include
    files). ``x`` should be a column reference or a bound value: it is read by every branch."""
    wrap_mode = _opt(conv, "wrap", "")
    cols_v = _opt(conv, "columns", 0)
    cols = _pick(_test(cols_v, ">", 0), cols_v, 72)
    cols = cols if isinstance(cols, Column) else F.lit(cols)
    atx = _opt(conv, "atx_headers", False)
    prefix = _opt(conv, "id_prefix", "")
    standalone = _opt(conv, "standalone", False) if standalone is None else standalone
    mode = wrap_mode if isinstance(wrap_mode, Column) else F.lit(wrap_mode)
    wrap_on = _test(wrap_mode, "in", ("auto", "none"))
    text_b = _pick(wrap_on, I.wrap_paragraphs(x, mode, cols), x) if isinstance(wrap_on, Column) else (
        I.wrap_paragraphs(x, mode, cols) if wrap_on else x)

    def markdown():
        plain_md = _pick(atx, R.render_markdown(text_b, True), R.render_markdown(text_b, False)) \
            if isinstance(atx, Column) else R.render_markdown(text_b, atx)
        if links is None:
            return plain_md
        location = _opt(conv, "reference_location", "document")
        location = location if isinstance(location, Column) else F.lit(location)
        atx_col = atx if isinstance(atx, Column) else F.lit(atx)
        return F.when(links.isNotNull(), I.render_markdown_refs(text_b, links, location, atx_col)).otherwise(plain_md)

    def html():
        pfx = prefix if isinstance(prefix, Column) else F.lit(prefix)
        secs = _opt(conv, "section_divs", False)
        secs_col = secs if isinstance(secs, Column) else F.lit(secs)
        body = _pick(_or(_test(prefix, "!=", ""), secs), I.render_html_ids(x, pfx, secs_col), R.render_html(x))
        header, before, after = page_parts(conv, files_col)
        return _chain(body).stage(standalone, lambda h: includes(h, header, before, after, True, F.lit(""))).value

    writers = {"plain": lambda: R.render_plain(text_b), "markdown": markdown, "html": html}
    if not isinstance(to, Column):
        return writers[to]() if to in writers else F.lit(None).cast("string")
    return F.when(to == "plain", writers["plain"]()).when(to == "markdown", writers["markdown"]()).when(
        to == "html", writers["html"]())


def render_by_options(blocks: Column, to, conv, files_col: Column | None = None,
                      links: Column | None = None) -> Column:
    """Block options, then the writer for ``to`` (``apply_block_options`` + ``write_text``) on a Column. ``to`` and
    ``conv`` are Columns (per-row options) or Python values (options fixed for the job)."""
    b = apply_block_options(blocks, conv)
    if isinstance(conv, Column) or isinstance(to, Column):
        return let(b, lambda y: write_text(y, to, conv, files_col, links))
    return write_text(b, to, conv, files_col, links)


def finish_output(text, to, conv):
    """Options that act on the written text: ascii, email_obfuscation=references (html output), extract_media with
    default_image_extension (inline data URIs -> ``<dir>/<md5><ext>``, M1 in the row), eol. Takes and returns a
    Column, or a ``Chain`` (stages applied in place)."""
    t = _chain(text)
    t.stage(_opt(conv, "ascii", False), N.ascii_refs)
    t.stage(_and(_test(to, "==", "html"), _test(_opt(conv, "email_obfuscation", ""), "==", "references")),
            N.email_refs)
    media_dir = _opt(conv, "extract_media", "")
    ext = _opt(conv, "default_image_extension", "")
    ext = _pick(_test(ext, "!=", ""), ext, "bin")
    t.stage(_test(media_dir, "!=", ""), lambda y: M.rewrite_media(y, media_dir, ext))
    t.stage(_test(_opt(conv, "eol", ""), "==", "crlf"), lambda y: N.eol(y, "crlf"))
    return t.flush() if isinstance(text, Chain) else t.value


def request_vars(conv: Column, files_col: Column | None = None, doc_meta: Column | None = None) -> Column:
    """Template variables of one request: ``variable`` (single values) first, then ``metadata`` (lists), the metadata file,
    and what the document brings along (``doc_meta``, ``document_metadata``); the first source of a name wins.
    ``title_prefix`` is put in front of every title (``prefix - title``) and is the title when there is none."""
    var_e = F.transform(F.map_entries(F.coalesce(conv["variable"], F.create_map().cast("map<string,string>"))),
                        lambda e: F.struct(e["key"].alias("key"), F.array(e["value"]).alias("value")))
    meta_e = F.transform(
        F.map_entries(F.coalesce(conv["metadata"], F.create_map().cast("map<string,array<string>>"))),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    parts = [var_e, meta_e]
    if files_col is not None:
        mfile = F.from_json(file_text(files_col, "metadata_file"), "map<string,array<string>>")
        parts.append(F.transform(F.map_entries(F.coalesce(mfile, F.create_map().cast("map<string,array<string>>"))),
                                 lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
        for var, opt in (("header-includes", "include_in_header"), ("include-before", "include_before_body"),
                         ("include-after", "include_after_body")):
            t = file_text(files_col, opt)
            parts.append(F.when(t.isNotNull(), F.array(F.struct(F.lit(var).alias("key"), F.array(t).alias("value"))))
                         .otherwise(F.array().cast("array<struct<key:string,value:array<string>>>")))
    if doc_meta is not None:
        parts.append(F.coalesce(doc_meta, F.array().cast(ENTRIES)))
    # the first entry of a name stays
    keep = let(F.concat(*parts), lambda es: let(F.transform(es, lambda e: e["key"]), lambda ks: F.filter(
        es, lambda e, i: F.array_position(ks, e["key"]) == i + 1)))
    prefix = F.coalesce(conv["title_prefix"], F.lit(""))
    keep = F.transform(keep, lambda e: F.when((e["key"] == "title") & (prefix != ""), F.struct(
        e["key"].alias("key"), F.transform(e["value"], lambda v: F.concat(prefix, F.lit(" - "), v)).alias("value")))
        .otherwise(e))
    has_title = F.exists(keep, lambda e: e["key"] == "title")
    fallback = F.when((prefix != "") & ~has_title, F.array(F.struct(F.lit("title").alias("key"),
                                                                    F.array(prefix).alias("value"))))
    return F.map_from_entries(F.concat(keep, F.coalesce(fallback, F.array().cast(
        "array<struct<key:string,value:array<string>>>"))))


def select_template(name: Column, registered: tuple[str, ...]) -> Column:
    """R2: a registered name, else (empty or unknown) the default template."""
    return F.when(name.isin(*registered), name).otherwise(F.lit(DEFAULT_TEMPLATE)) if registered else F.lit(
        DEFAULT_TEMPLATE)


def _empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def side_table(fetched: DataFrame, files: DataFrame, conf: JobConfig, crawl: DataFrame | None) -> DataFrame:
    """What the side files give each request, one row per (request_id, refs_hash): ``file_rule``, ``file_error``, ``file_texts``
    (rules 10/11), ``cites`` (citation key -> entry, from ``bibliography`` and ``citation_abbreviations``) and ``paths`` (resource
    reference -> path, from ``resource_path``). The last two are null for requests without these options.

    Requests with such options are read once, for the files they name and the keys and references of their documents, which
    are written to the shared folder: everything below reads these narrow rows, so no request is parsed again.
    Bibliographies are parsed once per file and shortened once per pair of files; the joins see only keys, references and
    paths, and no document moves."""
    spark = fetched.sparkSession
    conv, text = F.col("converter"), utf8_text(F.col("data"))
    cites, paths = (F.coalesce(conv[k], F.lit("")) != "" for k in ("bibliography", "resource_path"))
    read = F.col("fetch_error").isNull()
    asked = fetched.where(F.col("rule").isNull() & ((F.size(file_options()) > 0) | paths)).select(
        "request_id", refs_hash().alias("refs_hash"), file_options().alias("options"), conv["resource_path"].alias("resource_path"),
        F.when(read & cites, L.cited_keys(text)).alias("keys"), F.when(read & paths, M.resource_refs(text)).alias("refs"))
    path = scratch_path(spark, f"asked-{uuid.uuid4().hex}")
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    named_files = file_option_refs(asked)
    fr = resolve_file_options(named_files, files, conf.safe_dir, conf.safe_dir_mode, crawl)
    used = asked.where("keys is not null or refs is not null")
    if not used.limit(1).count():
        return fr.withColumns({"cites": F.lit(None).cast("map<string,string>"), "paths": F.lit(None).cast("map<string,string>")})
    tables = table_files(named_files, files, conf.safe_dir, conf.safe_dir_mode, crawl)
    by_option = lambda option: tables.where(F.col("option") == option).select("source", "text")
    bib_id, abbr_id = (F.try_element_at("file_ids", F.lit(k)).alias(a) for k, a in (("bibliography", "bib_id"), ("citation_abbreviations", "abbr_id")))
    named = fr.select(F.col("request_id").alias("f_id"), F.col("refs_hash").alias("f_hash"), bib_id, abbr_id).where("bib_id is not null")
    entries = L.citation_entries(named.select("bib_id", "abbr_id").distinct(), L.bibliography_entries(by_option("bibliography")),
                                 L.abbreviation_entries(by_option("citation_abbreviations")))
    cited = used.select("request_id", "refs_hash", F.explode("keys").alias("c_key")).distinct().join(
        named, F.col("request_id").eqNullSafe(F.col("f_id")) & (F.col("refs_hash") == F.col("f_hash"))).select(
            "request_id", "refs_hash", "c_key", F.col("bib_id").alias("c_bib"), F.col("abbr_id").alias("c_abbr"))
    cited = cited.join(entries, (F.col("c_bib") == F.col("bib_id")) & F.col("c_abbr").eqNullSafe(F.col("abbr_id")) & (
        F.col("c_key") == F.col("key"))).groupBy("request_id", "refs_hash").agg(
            F.map_from_entries(F.collect_list(F.struct("key", "entry"))).alias("cites"))
    found = M.resource_paths(used.select("request_id", "refs_hash", "resource_path", F.explode("refs").alias("ref")).distinct(),
                             files, conf.safe_dir, conf.safe_dir_mode)
    parts = [fr.drop("file_ids"), cited, found]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    # each column comes from one of the tables, so a group has one value of it
    return both.groupBy("request_id", "refs_hash").agg(*[F.first(c, ignorenulls=True).alias(c) for c in (
        "file_rule", "file_error", "file_texts", "cites", "paths")])


def convert_job(requests: DataFrame, conf: JobConfig = JobConfig(), fetch_options: dict | None = None,
                files: DataFrame | None = None, resources: DataFrame | None = None) -> DataFrame:
    """E1 over parsed requests. Output: request_id, src_format, dst_format, template, driver, rule, code, message,
    outcome (code, message, result{data}), template_used, status, content_type, response (bytes)."""
    if conf.document_template is not None:
        parse_template(conf.document_template)  # a bad template fails at job start, not per row
    v = validate_requests(requests, conf)
    f = dispatch_fetch(v, conf, fetch_options or {})
    conv = F.col("converter")
    files_col = None
    if files is not None:
        # one row per request that has side files; a left join on request_id whose strategy AQE picks from the measured
        # size of that table
        crawl = (fetch_options or {}).get("http", {})
        crawl = crawl.get("crawl") if crawl.get("unique") or crawl.get("crawl") is None else one_per_url(crawl["crawl"])
        side = side_table(f, files, conf, crawl)
        f = f.withColumn("rh__", refs_hash()).alias("f").join(side.alias("s"), F.col("f.request_id").eqNullSafe(
            F.col("s.request_id")) & (F.col("rh__") == F.col("refs_hash")), "left").select(
                "f.*", "file_rule", "file_error", "file_texts", "cites", "paths")
        files_col = F.col("file_texts")
    else:  # a file option without a file table is an error, not ignored
        file_rule, file_error = without_files()
        unset = F.col("rule").isNull()
        f = f.withColumn("file_rule", F.when(unset, file_rule)).withColumn("file_error", F.when(unset, file_error)) \
            .withColumn("file_texts", F.lit(None).cast("map<string,string>"))
    # W1 per request: warnings on the fetched source; with fail_if_warnings they make the request fail (rule 12)
    text = utf8_text(F.col("data"))
    kinds = [F.when(F.col("data").isNotNull() & ~utf8_valid(F.col("data")), F.lit("invalid_utf8")),
             F.when(F.col("data").isNotNull() & (conv["from"] == "html") & ~F.lower(text).contains("</body>"), F.lit("html_unclosed"))]
    cites_on, paths_on = (F.coalesce(conv[k], F.lit("")) != "" for k in ("bibliography", "resource_path"))
    if files is not None:
        f = f.withColumn("cites", F.coalesce("cites", _empty_map())).withColumn("paths", F.coalesce("paths", _empty_map()))
        kinds += [F.when(F.col("data").isNotNull() & cites_on & L.missing_citations(text, F.col("cites")), F.lit("unresolved_citation")),
                  F.when(F.col("data").isNotNull() & paths_on & F.exists(M.resource_refs(text), lambda r: F.try_element_at("paths", r).isNull()),
                         F.lit("unresolved_resource"))]
    warn = F.filter(F.array(*kinds), lambda x: x.isNotNull())
    warn_error = F.when((F.coalesce(conv["fail_if_warnings"], F.lit(False)) | F.lit(conf.fail_if_warnings)) & (F.size(warn) > 0),
                        F.concat(F.lit("failing because there were warnings: "), F.array_join(warn, ", ")))
    conv_error = F.coalesce(F.col("conv_error"), warn_error)
    rule = F.coalesce(F.col("rule"), F.when(F.col("fetch_error").isNotNull(), F.lit(9)), F.col("file_rule"),
                      F.when(conv_error.isNotNull(), F.lit(12)))
    err = F.coalesce(F.col("message"), F.col("fetch_error"), F.col("file_error"), conv_error)
    f = f.select("request_id", "converter", "template", "driver", rule.alias("rule"), err.alias("error"), "data",
                 "file_texts", warn.alias("warnings"), *(["cites", "paths"] if files is not None else []))
    ok = F.col("error").isNull()
    # each option stage below is a projection of its own (``Chain`` frame mode)
    raw = F.when(conv["from"] == "markdown", without_head(utf8_text(F.col("data")))).otherwise(utf8_text(F.col("data")))
    src = prepare_input(Chain(F.when(ok, raw), f, "src__"), conv["from"], conv, files_col)
    if files is not None:
        src.df = src.df.withColumn("entries__", F.when(ok & cites_on, L.reference_list(F.col("src__"), F.col("cites"))))
        src.stage(ok & cites_on, lambda y: L.cite_in_text(y, F.col("cites")))
        src.stage(ok & paths_on, lambda y: M.rewrite_refs(y, F.col("paths")))
        src.flush()
    standalone = F.coalesce(conv["standalone"], F.lit(False))
    own_template = F.lit(False) if files_col is None else file_text(files_col, "template").isNotNull()
    templated = own_template if conf.document_template is None else own_template | standalone
    if conf.document_template is not None or files is not None:
        src.df = src.df.withColumn("vars__", F.when(ok & templated, request_vars(conv, files_col, document_metadata(
            utf8_text(F.col("data")), conv["from"]))))
    refs_on = ok & (conv["from"] == "html") & F.coalesce(conv["reference_links"], F.lit(False))
    f = compute_once(src.df, blocks__=F.when(ok, parse_blocks(F.col("src__"), conv["from"])),
                     links__=F.when(refs_on, L.link_array(F.col("src__")))).drop("data", "src__")
    if conf.enable_filter:
        chain = Chain(df=f, name="blocks__")
        for name, fn in sorted(registry.filters().items()):
            chain.stage(ok & (F.coalesce(conv["filter"], F.lit("")) == name), fn)
        f = chain.flush().df
    f = apply_block_options(Chain(df=f, name="blocks__"), conv).df
    blocks = F.col("blocks__")
    if files is not None:  # the reference list goes after the document
        f = f.withColumn("blocks__", F.when(F.size("entries__") > 0, I.with_references(blocks, F.col("entries__"))).otherwise(blocks))
    # the body first, as a column: pages and templates then read it as often as they like
    f = f.withColumn("body__", F.when(ok, write_text(blocks, conv["to"], conv, files_col, F.col("links__"), standalone=False)))
    header, before, after = page_parts(conv, files_col)
    body = F.col("body__")
    rendered = F.when(standalone & (conv["to"] == "html"), includes(body, header, before, after, True, F.lit(""))).otherwise(body)
    if conf.document_template is not None:
        rendered = F.when(standalone, compile_template(conf.document_template, F.col("vars__"), body)).otherwise(rendered)
    if files is not None:  # a template of the request's own; like the job's it is a standalone page by itself
        f = compute_once(f, page__=F.when(ok & own_template, render_row(file_text(files_col, "template"), F.col("vars__"), body)))
        failed = F.concat(F.lit("template: "), F.col("page__.error"))
        f = f.withColumn("rule", F.coalesce("rule", F.when(failed.isNotNull(), F.lit(12)))).withColumn("error", F.coalesce("error", failed))
        rendered = F.when(own_template, F.col("page__.text")).otherwise(rendered)
    f = finish_output(Chain(F.when(ok, rendered), f, "rendered__"), conv["to"], conv).df
    f = f.drop("file_texts", "blocks__", "links__", "body__", "vars__", "page__", "entries__", "cites", "paths")
    if resources is not None:
        # self_contained (M2): only requests with the option go through the reference join. Their conversions are written to
        # the shared folder, since the join reads them twice (for the references, and to put the payloads in); the option
        # filter reads the converter struct only, so it is pushed down next to the parse, and every request is converted once
        on = F.coalesce(conv["self_contained"], F.lit(False)) & F.col("error").isNull()
        path = scratch_path(f.sparkSession, f"converted-{uuid.uuid4().hex}")
        f.filter(on).write.parquet(path)
        done = f.sparkSession.read.schema(f.schema).parquet(path)
        embedded = M.self_contained(done.withColumnRenamed("request_id", "doc_id"), resources, None,
                                    "rendered__").withColumnRenamed("doc_id", "request_id")
        f = f.filter(~on).unionByName(embedded.select(*f.columns))
    outcome = envelope(F.col("error"), utf8(F.col("rendered__")))
    to = conv["to"]
    custom = registry.templates()
    used = select_template(F.col("template"), tuple(dict.fromkeys([*conf.templates, *custom])))
    out = f.select(
        "request_id", conv["from"].alias("src_format"), to.alias("dst_format"), "template", "driver",
        F.coalesce("rule", F.lit(0)).cast("int").alias("rule"), outcome.alias("outcome"), used.alias("template_used"),
        "warnings",
    )
    o = F.col("outcome")
    binary = render_binary(o, F.col("dst_format"))
    response = (
        F.when(F.col("template_used") == "binary", binary["body"])
        .when(F.col("template_used") == "render-html", utf8(render_embed(o, F.col("dst_format"))))
    )
    for name, fn in sorted(custom.items()):  # X2: text from (outcome, format)
        if name not in ("binary", "render-html"):
            response = response.when(F.col("template_used") == name, utf8(fn(o, F.col("dst_format"))))
    response = response.otherwise(utf8(render_default(o)))
    return out.select(
        "*", o["code"].alias("code"), o["message"].alias("message"),
        F.when(F.col("template_used") == "binary", binary["status"]).otherwise(F.lit(200)).alias("status"),
        F.when(F.col("template_used") == "binary", binary["content_type"]).alias("content_type"),
        response.alias("response"),
    )


def outcome_view(out: DataFrame) -> DataFrame:
    """Compact comparable view of E1 outcomes."""
    return out.select(
        "request_id", F.col("code").cast("bigint").alias("code"), F.col("rule").cast("bigint").alias("rule"),
        "message", F.md5(F.col("outcome.result.data")).alias("data_md5"), "template_used",
        F.md5("response").alias("response_md5"),
    )


def options_fingerprint(conv: Column) -> Column:
    """One value for converter structs that ask for the same: unset fields and fields at their neutral value (false, 0, empty) are
    alike, and the order of map entries does not matter (the option table J1 drops and sorts them)."""
    return md5_text(F.to_json(option_entries(conv)))


def convert_distinct(docs: DataFrame, frm: str | None = None, to: str | None = None, options: dict | None = None,
                     content: str = "content", converter: str | None = None) -> DataFrame:
    """Convert each distinct (md5, length) of content once and give the result to every document that has it. With
    ``converter``, a column of converter structs, each row has options of its own (``from`` and ``to`` included), and only
    documents with the same content and the same options (``options_fingerprint``) share a conversion.

    ``doc_id`` identifies a document. Only fingerprints are read to find the repeats; every first document (smallest
    ``doc_id`` of its text) is converted where it is read, without a shuffle of texts, and the repeats take over the
    result of their first one. The fingerprint count is a hash aggregate with a map-side partial step, so a text copied
    into a third of the corpus is reduced per task. A NULL content is no repeat of another. The ids of the repeats are
    written to the shared checkpoint folder, so that a lost executor does not send later steps back through the content;
    without any repeat the documents are read just once more."""
    spark = docs.sparkSession
    asked = F.lit("") if converter is None else options_fingerprint(F.col(converter))
    keyed = docs.select("doc_id", md5_text(F.col(content)).alias("h"), F.length(content).alias("n"), asked.alias("o"))
    several = keyed.where("h is not null").groupBy("h", "n", "o").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    path = scratch_path(spark, f"repeats-{uuid.uuid4().hex}")
    keyed.join(several, ["h", "n", "o"]).where("doc_id != first_id").select("doc_id", "first_id").write.parquet(path)
    repeats = spark.read.schema(f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, first_id "
                                f"{keyed.schema['doc_id'].dataType.simpleString()}").parquet(path)
    found = repeats.limit(BROADCAST_ROWS + 1).count()
    bounded = F.broadcast if found <= BROADCAST_ROWS else (lambda df: df)
    conv = options if options is not None else {"from": frm, "to": to}

    def converted(df: DataFrame) -> DataFrame:
        if converter is not None:
            own = F.col("conv")
            src = prepare_input(F.col("c"), own["from"], own)
            text = render_by_options(parse_blocks(src, own["from"]), own["to"], own)
            return df.select("doc_id", finish_output(text, own["to"], own).alias("converted"))
        blocks = B.block_array(prepare_input(F.col("c"), frm, conv), frm)
        return df.select("doc_id", finish_output(render_by_options(blocks, to, conv), to, conv).alias("converted"))

    rows = docs.select("doc_id", F.col(content).alias("c"), *([] if converter is None else [F.col(converter).alias("conv")]))
    if not found:
        return converted(rows)
    first = converted(rows.join(bounded(repeats.select("doc_id")), "doc_id", "left_anti"))
    origins = repeats.select(F.col("first_id").alias("doc_id")).distinct()
    again = converted(rows.join(bounded(origins), "doc_id", "left_semi")).withColumnRenamed("doc_id", "first_id")
    return first.unionByName(repeats.join(again, "first_id").select("doc_id", "converted"))


def write_documents(out: DataFrame, path: str) -> None:
    """Successful conversions as Parquet ``(request_id, name, dst_format, content)`` partitioned by the format;
    the file name extension is the raw ``to`` string. Overwrites the target (idempotent on retry)."""
    ok = out.filter(F.col("code") == 0).select(
        "request_id", F.concat(F.col("request_id").cast("string"), F.lit("."), F.col("dst_format")).alias("name"),
        "dst_format", F.col("outcome.result.data").alias("content"))
    ok.write.mode("overwrite").partitionBy("dst_format").parquet(path)
