"""Oracle SQL, step 5: links, citations, media, resources, warnings."""

from __future__ import annotations

from quire.model import MIME_EXT
from quire.operators.blocks import HTML_MARK_RE, HTML_STRIP_RE
from quire.operators.links import ANCHOR_RE, CITE_RE
from quire.operators.media import INLINE_URI_RE
from quire.plans import sqlparts as S
from quire.plans.oracle import PAGES, SQL

A = S.q(ANCHOR_RE)
_ANCHOR_TEXT = "trim(regexp_replace(regexp_replace(regexp_extract_all(p, {a}, 2)[j], '<[^>]*>', ' ', 'g'), " \
               "'[ \\t\\r\\n]+', ' ', 'g'))".format(a=A)
LINKS = f"""(SELECT doc_id, CAST(generate_subscripts(ls, 1) AS INTEGER) AS n, unnest(ls, recursive := true)
  FROM (SELECT doc_id, flatten(list_transform(ps, lambda p, i: list_transform(regexp_extract_all(p, {A}, 1),
      lambda h, j: struct_pack(block_no := CAST(i - 1 AS INTEGER), href := h, text := {_ANCHOR_TEXT})))) AS ls
    FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(content, {S.q(HTML_STRIP_RE)}, '', 'g'),
            {S.q(HTML_MARK_RE)}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM {PAGES})))"""

CITE_DOCS = """(SELECT doc_id, text || ' [@k' || CAST(doc_id % (SELECT count(*) * 5 // 4 FROM benchmark) AS VARCHAR) || '] and [@k'
  || CAST((doc_id * 7) % (SELECT count(*) * 5 // 4 FROM benchmark) AS VARCHAR) || ']' AS content FROM documents)"""
CITES = f"""(SELECT doc_id, CAST(generate_subscripts(ks, 1) AS INTEGER) AS n, unnest(ks) AS key
  FROM (SELECT doc_id, regexp_extract_all(content, {S.q(CITE_RE)}, 1) AS ks FROM {CITE_DOCS}))"""
BIB = "(SELECT 'k' || CAST(item_id AS VARCHAR) AS key, text AS entry FROM benchmark)"
MISSING = f"(SELECT DISTINCT doc_id, key FROM {CITES} WHERE key NOT IN (SELECT key FROM {BIB}))"

MEDIA_DOCS = """(SELECT doc_id, text || ' ![a](data:text/plain;base64,' || to_base64(encode(split_part(text, chr(10), 1)))
  || ') ![b](data:image/png;base64,' || to_base64(encode(lang || '/' || source)) || ')' AS content FROM documents)"""
U = S.q(INLINE_URI_RE)


def ext(ct: str) -> str:
    return f"(CASE {ct} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIME_EXT.items()) + " ELSE '.bin' END)"


_MEDIA_REF = f"'media/' || md5(from_base64(regexp_extract(tk, {U}, 2))) || {ext(f'regexp_extract(tk, {U}, 1)')}"
FOUND = f"""(SELECT md5(from_base64(regexp_extract(uri, {U}, 2))) AS md5, regexp_extract(uri, {U}, 1) AS ct,
    from_base64(regexp_extract(uri, {U}, 2)) AS data
  FROM (SELECT unnest(regexp_extract_all(content, {U}, 0)) AS uri FROM {MEDIA_DOCS}))"""

REFS = f"(SELECT doc_id, n, regexp_replace(href, '^/', '') AS ref FROM {LINKS})"
FILES = """(SELECT DISTINCT path FROM (SELECT 'assets/' || split_part(text, ' ', 1) AS path FROM documents
  WHERE doc_id % 2 = 0 UNION ALL SELECT 'cdn/' || split_part(text, ' ', 1) FROM documents WHERE doc_id % 3 = 0))"""
RESOLVED = f"""(SELECT doc_id, n, ref, arg_min(CASE WHEN f.path IS NOT NULL THEN c.path END,
    CASE WHEN f.path IS NOT NULL THEN pos END) AS resolved
  FROM (SELECT *, dir || '/' || ref AS path FROM (SELECT doc_id, n, ref, unnest(['static', 'assets', 'cdn']) AS dir,
          generate_subscripts(['static', 'assets', 'cdn'], 1) - 1 AS pos FROM {REFS})) c
  LEFT JOIN {FILES} f ON f.path = c.path GROUP BY doc_id, n, ref)"""

SQL["link_table"] = f"SELECT doc_id, n, block_no, href, text FROM {LINKS}"
_FIRST = "SELECT doc_id, {scope} AS scope, href, min(n) AS first_n FROM " + LINKS + " GROUP BY ALL"
SQL["reference_links"] = f"""SELECT doc_id, CAST(scope AS BIGINT) AS scope,
  row_number() OVER (PARTITION BY doc_id, scope ORDER BY first_n) AS ref_no, href, first_n
  FROM ({_FIRST.format(scope='0')})"""
SQL["reference_links_block"] = f"""SELECT doc_id, CAST(scope AS BIGINT) AS scope,
  row_number() OVER (PARTITION BY doc_id, scope ORDER BY first_n) AS ref_no, href, first_n
  FROM ({_FIRST.format(scope='block_no')})"""
SQL["citations"] = f"""SELECT doc_id, n, key, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY first_n) AS INTEGER)
  AS cite_no, md5(entry) AS entry_md5
  FROM (SELECT c.doc_id, c.n, c.key, b.entry, min(c.n) OVER (PARTITION BY c.doc_id, c.key) AS first_n
        FROM {CITES} c JOIN {BIB} b ON b.key = c.key)"""
SQL["citations_missing"] = f"SELECT doc_id, key FROM {MISSING}"
SQL["citation_abbreviations"] = """SELECT b.key, coalesce(a.short, b.container) AS container
  FROM (SELECT 'k' || CAST(item_id AS VARCHAR) AS key, regexp_extract(text, '^(\\S+ \\S+)', 1) AS container
        FROM benchmark) b
  LEFT JOIN (SELECT "full", min(short) AS short FROM (SELECT regexp_extract(text, '^(\\S+ \\S+)', 1) AS "full",
               'J' || CAST(item_id AS VARCHAR) AS short FROM benchmark WHERE item_id % 2 = 0) GROUP BY "full") a
  ON b.container = a."full"
"""
SQL["extract_media"] = f"""SELECT z.doc_id, md5(CASE WHEN len(regexp_extract_all(z.c, {U}, 0)) > 0 THEN z.r ELSE z.c END)
    AS content_md5, CAST(len(regexp_extract_all(z.c, {U}, 0)) AS BIGINT) AS n_media
  FROM {S.zip_tokens(f"(SELECT doc_id, content AS c FROM {MEDIA_DOCS})", 'doc_id, c', 'c', INLINE_URI_RE,
                     _MEDIA_REF, 'r')} z"""
SQL["extract_media_resources"] = f"""SELECT md5, ct AS content_type, 'media/' || md5 || {ext('ct')} AS path,
  count(*) AS n_uses, CAST(octet_length(first(data)) AS BIGINT) AS n_bytes FROM {FOUND} GROUP BY md5, ct"""
SQL["self_contained"] = f"SELECT doc_id, md5(content) AS content_md5 FROM {MEDIA_DOCS}"
SQL["resolve_resources"] = f"SELECT * FROM {RESOLVED}"
SQL["warnings"] = f"""SELECT page_id AS doc_id, 'html_unclosed' AS kind, 'no </body>' AS detail FROM pages
    WHERE NOT contains(lower(html), '</body>')
  UNION ALL SELECT doc_id, 'unresolved_citation', key FROM {MISSING}
  UNION ALL SELECT doc_id, 'unresolved_resource', ref FROM {RESOLVED} WHERE resolved IS NULL"""

SECTIONS = f"""(SELECT doc_id, block_no, sum(CASE WHEN kind = 'heading' AND level <= 1 THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_no
  FROM {S.html_blocks(PAGES)})"""
SQL["reference_links_section"] = f"""SELECT doc_id, CAST(scope AS BIGINT) AS scope,
  row_number() OVER (PARTITION BY doc_id, scope ORDER BY first_n) AS ref_no, href, first_n
  FROM (SELECT l.doc_id, coalesce(s.section_no, 0) AS scope, l.href, min(l.n) AS first_n
        FROM {LINKS} l LEFT JOIN {SECTIONS} s ON s.doc_id = l.doc_id AND s.block_no = l.block_no
        GROUP BY ALL)"""
