"""Schemas and job configuration.

A conversion request is one row: ``request_id``, ``fetcher struct<name, params>`` (``params`` kept as raw JSON text
whose shape depends on the driver), ``converter`` (the option struct below) and ``template``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The option fields of a conversion request, in the order their flags are emitted, with their types:
# b bool, i int, s string, f string naming a file, m map<string,string>, mm map<string,array<string>>.
OPTION_FIELDS: list[tuple[str, str]] = [
    ("strip_empty_paragraphs", "b"), ("preserve_tabs", "b"), ("file_scope", "b"), ("standalone", "b"),
    ("strip_comments", "b"), ("toc", "b"), ("no_highlight", "b"), ("self_contained", "b"), ("html_q_tags", "b"),
    ("ascii", "b"), ("reference_links", "b"), ("atx_headers", "b"), ("number_sections", "b"), ("listings", "b"),
    ("incremental", "b"), ("section_divs", "b"), ("natbib", "b"), ("biblatex", "b"), ("mathml", "b"),
    ("gladtex", "b"), ("fail_if_warnings", "b"), ("variable", "m"), ("metadata", "mm"), ("metadata_file", "f"),
    ("request_header", "m"), ("from", "s"), ("to", "s"), ("data_dir", "s"), ("base_header_level", "i"),
    ("indented_code_classes", "s"), ("filter", "s"), ("lua_filter", "s"), ("tab_stop", "i"), ("track_changes", "s"),
    ("extract_media", "s"), ("template", "f"), ("print_default_template", "s"), ("print_default_data_file", "s"),
    ("print_highlight_style", "s"), ("dpi", "i"), ("eol", "s"), ("wrap", "s"), ("columns", "i"), ("toc_depth", "i"),
    ("highlight_style", "s"), ("syntax_definition", "f"), ("include_in_header", "f"), ("include_before_body", "f"),
    ("include_after_body", "f"), ("resource_path", "s"), ("reference_location", "s"), ("top_level_division", "s"),
    ("number_offset", "i"), ("slide_level", "i"), ("default_image_extension", "s"), ("email_obfuscation", "s"),
    ("id_prefix", "s"), ("title_prefix", "s"), ("css", "s"), ("reference_doc", "f"), ("epub_subdirectory", "s"),
    ("epub_cover_image", "f"), ("epub_metadata", "f"), ("epub_embed_font", "f"), ("epub_chapter_level", "i"),
    ("pdf_engine", "s"), ("pdf_engine_opt", "s"), ("bibliography", "f"), ("csl", "f"),
    ("citation_abbreviations", "f"), ("webtex", "s"), ("mathjax", "s"), ("katex", "s"), ("latexmathml", "s"),
    ("mimetex", "s"), ("jsmath", "s"), ("abbreviations", "f"),
]

# Enumerated options and their allowed values. An unknown value is a conversion error.
ENUMS = {
    "track_changes": ("accept", "reject", "all"),
    "eol": ("crlf", "lf", "native"),
    "wrap": ("auto", "none", "preserve"),
    "reference_location": ("block", "section", "document"),
    "top_level_division": ("section", "chapter", "part"),
    "email_obfuscation": ("none", "javascript", "references"),
}

# File options whose resolution failure is an error in the reference, and the six whose failure
# the reference swallows (we report an error for all fourteen).
FILE_OPTIONS_STRICT = ("reference_doc", "epub_cover_image", "epub_metadata", "epub_embed_font", "bibliography", "csl",
                       "citation_abbreviations", "abbreviations")
FILE_OPTIONS_LENIENT = ("metadata_file", "template", "syntax_definition", "include_in_header", "include_before_body",
                        "include_after_body")

# The reference's messages, in its wording ({name} marks an inserted value).
MESSAGES = {
    "converter_nil": "converter options is nil",
    "fetcher_nil": "fetcher options is nil",
    "data_dir_unsafe": "DataDir: '{data_dir}' is not in safe dir: '{safe_dir}'",
    "no_input": "non input method, please check your fetcher options or uri param",
    "fetcher_missing": "fetcher {name} not exist",
    "param_failure": "parse param failure",
    "data_empty": "[fetcher-data]: params of data is empty",
    "url_empty": "[fetcher-http]: params of url is empty",
    "method_unsupported": "[fetcher-http]: method {method} not support",
    "fetch_failure": "[fetcher-http]: fetch url by {method} failure <{url}>, status code is {status}",
    "driver_name_empty": "fetcher driver name is empty",
    "driver_fn_nil": "the fetcher driver of {name}'s new func is nil",
    "driver_exists": "driver of {name} already exist",
    "driver_missing": "fetcher driver of {name} not exist",
    "instance_name_bad": "fetcher name could not be '' or 'default'",
    "instance_exists": "fetcher of {name} already exist",
    "instance_driver_empty": "the fetcher of {name}'s driver is empty",
}


def message(key: str, **values) -> str:
    return MESSAGES[key].format(**values)


# Content type -> file extension.
MIME_EXT = {
    "text/html": ".html", "text/plain": ".txt", "text/markdown": ".md", "application/pdf": ".pdf",
    "image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/svg+xml": ".svg", "image/webp": ".webp",
    "image/tiff": ".tiff", "image/bmp": ".bmp", "text/css": ".css", "text/csv": ".csv", "text/xml": ".xml",
    "text/javascript": ".js", "application/json": ".json", "application/xml": ".xml", "application/zip": ".zip",
    "application/epub+zip": ".epub", "application/msword": ".doc", "application/rtf": ".rtf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.oasis.opendocument.text": ".odt",
}

# Ranges of the integer options; other values are option errors (rule 12). tab_stop, columns and toc_depth of 0 or less
# stand for the default.
INT_RANGES = {"base_header_level": (-100, 100), "number_offset": (-1_000_000_000, 1_000_000_000), "tab_stop": (-1000, 1000),
              "columns": (-100_000, 100_000), "toc_depth": (-100, 100)}

_TYPES = {
    "b": T.BooleanType(), "i": T.IntegerType(), "s": T.StringType(), "f": T.StringType(),
    "m": T.MapType(T.StringType(), T.StringType()),
    "mm": T.MapType(T.StringType(), T.ArrayType(T.StringType())),
}


def flag_name(key: str) -> str:
    """Command-line spelling of an option: ``--`` + key with ``_`` -> ``-``."""
    return "--" + key.replace("_", "-")


CONVERTER_SCHEMA = T.StructType([T.StructField(k, _TYPES[t]) for k, t in OPTION_FIELDS])
FETCHER_SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("params", T.StringType())])
REQUEST_SCHEMA = T.StructType([
    T.StructField("fetcher", FETCHER_SCHEMA),
    T.StructField("converter", CONVERTER_SCHEMA),
    T.StructField("template", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])
DATA_PARAMS = "data string"
HTTP_PARAMS = "url string, method string, headers map<string,string>, data string, replace map<string,string>"


@dataclass(frozen=True)
class FetcherConf:
    driver: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class JobConfig:
    """Job-level settings (the service configuration of the reference, as a dataclass)."""

    safe_dir: str = "/app"
    safe_dir_mode: str = "strict"  # strict | prefix
    enable_filter: bool = False
    enable_lua_filter: bool = False
    fetchers: tuple[tuple[str, FetcherConf], ...] = (("http", FetcherConf("http")), ("data", FetcherConf("data")))
    templates: tuple[str, ...] = ("render-html", "binary")
    fail_if_warnings: bool = False
    # text of the document template applied to standalone conversions (T1 syntax); None = built-in HTML page
    document_template: str | None = None

    def fetcher_names(self) -> list[str]:
        return [n for n, _ in self.fetchers]
