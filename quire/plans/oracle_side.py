"""Oracle SQL of the conversion job with side files."""

from __future__ import annotations

from quire.plans import sqlparts as S
from quire.plans.oracle import DOCS, MD_DOCS, SQL
from quire.plans.oracle_links import CITE_DOCS
from quire.plans.oracle_results import page

_NL = "chr(10)"
_MDB = S.markdown_blocks(MD_DOCS)


def view(src: str) -> str:
    """``src(doc_id, rule, message, r)``: message null on success."""
    return f"""SELECT doc_id AS request_id, CAST(CASE WHEN message IS NULL THEN 0 ELSE 400 END AS BIGINT) AS code,
  CAST(CASE WHEN message IS NULL THEN 0 ELSE rule END AS BIGINT) AS rule, coalesce(message, '') AS message,
  CASE WHEN message IS NULL THEN md5(r) END AS data_md5 FROM {src}"""


_BODY = f"""(SELECT d.doc_id, d.lang, CASE WHEN d.doc_id % 2 = 0 THEN coalesce(m.content, '') ELSE coalesce(h.content, '') END AS body
  FROM documents d LEFT JOIN {S.render_markdown_agg(_MDB, atx=False)} m ON m.doc_id = d.doc_id
  LEFT JOIN {S.render_html_agg(_MDB)} h ON h.doc_id = d.doc_id)"""
SQL["convert_templates"] = view(f"""(SELECT doc_id, 12 AS rule, CASE WHEN doc_id % 4 = 3 THEN 'template: $if(x)$ is not closed' END AS message,
    CASE doc_id % 4 WHEN 0 THEN 'T' || n || ': Doc ' || n || {_NL} || body
      WHEN 1 THEN 'ann; ed' || doc_id % 5 || ' - ' || CASE WHEN doc_id % 3 = 0 THEN 'D' ELSE 'F' || n END || {_NL} || body
      ELSE array_to_string(list_transform(['1', '2'], lambda a: a || '.ann' || n || ',' || a || '.ed' || doc_id % 5 || n), '|') || '$ ' || body END AS r
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS n FROM {_BODY}))""")

_META = f"""(SELECT d.doc_id, d.lang, CAST(d.doc_id AS VARCHAR) AS n, d.doc_id % 2 = 1 AS html, d.doc_id % 4 = 2 AS head,
    CASE WHEN d.doc_id % 2 = 1 THEN trim(regexp_replace(split_part(d.text, chr(10), 1), '[ \\t\\r\\n]+', ' ', 'g'))
      ELSE coalesce(m.content, '') END AS body
  FROM documents d LEFT JOIN {S.render_plain_agg(_MDB)} m ON m.doc_id = d.doc_id)"""
SQL["convert_document_metadata"] = view(f"""(SELECT doc_id, 0 AS rule, NULL AS message,
    CASE WHEN doc_id % 5 = 0 THEN 'Asked' WHEN doc_id % 3 = 0 THEN 'file ' || n WHEN html THEN 'H ' || n || ' & co'
      WHEN head THEN 'Head ' || n ELSE '' END
    || '|' || CASE WHEN html THEN 'm1;m<2' WHEN head THEN 'a' || doc_id % 3 || ';b c' ELSE '' END
    || '|' || CASE WHEN head THEN 'x;' || lang ELSE '' END || '|' || CASE WHEN doc_id % 3 = 0 THEN 'f' ELSE '' END || '|' || body AS r
  FROM {_META})""")


def _cited(container: str) -> str:
    """Documents with [@key] citations, each with the bibliography of its id: keys of its items are known."""
    known = "list_filter(ks, lambda k: substr(k, 2)::BIGINT % 3 = doc_id % 3 AND substr(k, 2)::BIGINT < items)"
    keys = f"(SELECT *, {known} AS known FROM (SELECT doc_id, content, list_distinct_in_order AS ks, (SELECT count(*) FROM benchmark) AS items FROM (" \
           f"SELECT doc_id, content, CASE WHEN a = b THEN [a] ELSE [a, b] END AS list_distinct_in_order FROM (SELECT doc_id, content, " \
           f"regexp_extract_all(content, '\\[@([A-Za-z0-9_:.-]+)\\]', 1)[-2] AS a, regexp_extract_all(content, '\\[@([A-Za-z0-9_:.-]+)\\]', 1)[-1] AS b " \
           f"FROM {CITE_DOCS}))))"
    put = "replace({t}, '[@' || ks[{k}] || ']', CASE WHEN list_position(known, ks[{k}]) > 0 THEN '[' || list_position(known, ks[{k}]) || ']' ELSE '[@' || ks[{k}] || ']' END)"
    second = f"CASE WHEN len(ks) > 1 THEN {put.format(t=put.format(t='content', k=1), k=2)} ELSE {put.format(t='content', k=1)} END"
    numbered = f"(SELECT doc_id, ks, known, {second} AS content FROM {keys})"
    entry = f"'F' || b.item_id || ', G. ' || CASE WHEN regexp_matches(b.text, '^[A-Za-z]') THEN regexp_extract(b.text, '^([A-Za-z]+)', 1) || '. ' ELSE '' END || {container} || '. ' || (2000 + b.item_id % 20) || '.'"
    entries = f"""(SELECT doc_id, 1000000000 + pos AS block_no, 'para' AS kind, 0 AS level, '[' || pos || '] ' || {entry} AS text
      FROM (SELECT doc_id, unnest(known) AS key, generate_subscripts(known, 1) AS pos FROM {keys}) c JOIN benchmark b ON 'k' || b.item_id = c.key)"""
    blocks = f"(SELECT * FROM {S.plain_blocks(numbered)} UNION ALL SELECT * FROM {entries})"
    return view(f"""(SELECT k.doc_id, 12 AS rule, CASE WHEN k.doc_id % 7 = 3 AND len(known) < len(ks)
      THEN 'failing because there were warnings: unresolved_citation' END AS message,
    CASE WHEN k.doc_id % 2 = 0 THEN coalesce(p.content, '') ELSE coalesce(h.content, '') END AS r
  FROM {keys} k LEFT JOIN {S.render_plain_agg(blocks)} p ON p.doc_id = k.doc_id
  LEFT JOIN {S.render_html_agg(blocks)} h ON h.doc_id = k.doc_id)""")


SQL["convert_citations"] = _cited("'Journal ' || b.item_id % 4")
SQL["convert_citation_abbreviations"] = _cited(
    "CASE WHEN doc_id % 2 = 0 AND b.item_id % 4 < 3 THEN 'J' ELSE 'Journal ' END || b.item_id % 4")

_FOUND = "(SELECT doc_id, CASE source WHEN 'src0' THEN '/app/src0/' WHEN 'src1' THEN '/app/src1/' WHEN 'src2' THEN '/app/src2/' END AS dir FROM documents)"
_IMAGES = f"""(SELECT d.doc_id, a.dir IS NOT NULL AND b.dir IS NOT NULL AS all_found, d.text || chr(10) || chr(10)
    || '![own](' || coalesce(a.dir, '') || 'img/' || d.doc_id || '.png) ![other](' || coalesce(b.dir, '') || 'img/' || b.doc_id
    || '.png "t") ![far](http://a.b/img/1.png) <img src="' || coalesce(a.dir, '') || 'img/../img/' || d.doc_id || '.png">' AS content
  FROM documents d JOIN {_FOUND} a ON a.doc_id = d.doc_id JOIN {_FOUND} b ON b.doc_id = (d.doc_id * 7) % (SELECT count(*) FROM documents))"""
SQL["convert_resource_path"] = view(f"""(SELECT i.doc_id, 12 AS rule, CASE WHEN i.doc_id % 7 = 3 AND NOT all_found
      THEN 'failing because there were warnings: unresolved_resource' END AS message, coalesce(p.content, '') AS r
  FROM {_IMAGES} i LEFT JOIN {S.render_plain_agg(S.plain_blocks(_IMAGES))} p ON p.doc_id = i.doc_id)""")

_BEFORE = """(SELECT d.doc_id, d.lang, b.text AS item, p.url, p.html, p.page_id % 10 = 0 AS failed,
    d.doc_id % (SELECT count(*) * 6 // 5 FROM pages) AS asked
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
  LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) * 6 // 5 FROM pages))"""
SQL["convert_file_schemes"] = view(f"""(SELECT w.doc_id, 11 AS rule,
    CASE WHEN w.doc_id % 3 = 2 AND url IS NULL THEN 'include_before_body: fetch url by GET failure <http://missing.example/' || asked || '>, no snapshot'
      WHEN w.doc_id % 3 = 2 AND failed THEN 'include_before_body: [fetcher-http]: fetch url by GET failure <' || url || '>, status code is 404' END AS message,
    {page("''", "''", "concat_ws(chr(10), CASE w.doc_id % 3 WHEN 0 THEN item WHEN 1 THEN '<p>in ' || w.lang || '</p>' ELSE html END, coalesce(h.content, ''))")} AS r
  FROM {_BEFORE} w LEFT JOIN {S.render_html_agg(S.plain_blocks(DOCS))} h ON h.doc_id = w.doc_id)""")

_PB = S.plain_blocks(DOCS)
SQL["convert_distinct_options"] = f"""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN {S.eol_crlf('r')} ELSE r END) AS content_md5
  FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN coalesce(p.content, '') ELSE coalesce(h.content, '') END AS r FROM documents d
    LEFT JOIN {S.render_plain_agg(_PB)} p ON p.doc_id = d.doc_id LEFT JOIN {S.render_html_agg(_PB)} h ON h.doc_id = d.doc_id)"""
