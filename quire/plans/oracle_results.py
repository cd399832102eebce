"""Oracle SQL, steps 6-7: the conversion job, outcomes, renderings, templates, metadata, dedup conversion."""

from __future__ import annotations

from quire.plans import sqlparts as S
from quire.plans.oracle import DOCS, INLINE, SNAPSHOT, SQL, validated

COLS = "request_id, conv, template, name, rule, message"
FETCHED_FULL = f"""(SELECT {COLS}, fetch_error, data FROM {SNAPSHOT}
  UNION ALL SELECT {COLS}, fetch_error, data FROM {INLINE}
  UNION ALL SELECT {COLS}, NULL, NULL FROM {validated()} WHERE rule IS NOT NULL)"""

STAGED = f"""(SELECT *, coalesce(rule, CASE WHEN fetch_error IS NOT NULL THEN 9 END,
      CASE WHEN conv_error IS NOT NULL THEN 12 END) AS final_rule,
    coalesce(message, fetch_error, conv_error) AS error
  FROM (SELECT *, CASE WHEN conv IS NULL THEN NULL
        WHEN coalesce(frm, '') NOT IN ('html', 'markdown', 'plain') THEN 'input format ''' || coalesce(frm, '')
          || ''' is not supported'
        WHEN coalesce(dst, '') NOT IN ('plain', 'markdown', 'html') THEN 'output format ''' || coalesce(dst, '')
          || ''' is not supported' END AS conv_error
    FROM (SELECT *, json_extract_string(conv, '$.from') AS frm, json_extract_string(conv, '$.to') AS dst,
            coalesce(json_extract_string(conv, '$.standalone'), 'false') = 'true' AS standalone
          FROM {FETCHED_FULL})))"""

OK_DOCS_HTML = f"(SELECT request_id AS doc_id, decode(data) AS content FROM {STAGED} WHERE error IS NULL AND frm = 'html')"
OK_DOCS_PLAIN = f"(SELECT request_id AS doc_id, decode(data) AS content FROM {STAGED} WHERE error IS NULL AND frm = 'plain')"
BLOCKS = f"(SELECT * FROM {S.html_blocks(OK_DOCS_HTML)} UNION ALL SELECT * FROM {S.plain_blocks(OK_DOCS_PLAIN)})"
PAGE_HEAD = "'<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<meta charset=\"utf-8\">' " \
            "|| chr(10) || '<title>'"


def page(title: str, header: str, core: str) -> str:
    return (f"({PAGE_HEAD} || {S.html_escape(title)} || '</title>' || chr(10) || {header} || chr(10) || '</head>' "
            f"|| chr(10) || '<body>' || chr(10) || {core} || chr(10) || '</body>' || chr(10) || '</html>')")


OUTCOMES = f"""(SELECT s.request_id, CASE WHEN s.name IN ('data', 'http') THEN s.name END AS driver, s.frm, s.dst,
    s.template, CAST(coalesce(s.final_rule, 0) AS BIGINT) AS rule,
    CAST(CASE WHEN s.error IS NULL THEN 0 ELSE 400 END AS BIGINT) AS code, coalesce(s.error, '') AS message,
    CASE WHEN s.error IS NULL THEN CASE WHEN s.dst = 'markdown' THEN coalesce(m.content, '')
      WHEN s.dst = 'html' AND s.standalone THEN {page("''", "''", "coalesce(h.content, '')")}
      WHEN s.dst = 'html' THEN coalesce(h.content, '') END END AS rendered,
    CASE WHEN s.template IN ('render-html', 'binary') THEN s.template ELSE 'default' END AS template_used
  FROM {STAGED} s
  LEFT JOIN {S.render_markdown_agg(BLOCKS, atx=False)} m ON m.doc_id = s.request_id
  LEFT JOIN {S.render_html_agg(BLOCKS)} h ON h.doc_id = s.request_id)"""

DEFAULT_JSON = ("'{\"code\":' || CAST(code AS VARCHAR) || ',\"message\":' || to_json(message) || CASE WHEN code = 0 "
                "THEN ',\"result\":{\"data\":\"' || to_base64(encode(rendered)) || '\"}' ELSE '' END || '}'")
EMBED = (f"'<html>' || chr(10) || '<body>' || chr(10) || CASE WHEN code = 0 AND dst = 'pdf' THEN "
         f"'<embed src=\"data:application/pdf;base64,' || to_base64(encode(rendered)) || "
         f"'\" type=\"application/pdf\" width=\"100%\" height=\"100%\"/>' WHEN code = 0 THEN '' "
         f"ELSE {S.html_escape('message')} END || chr(10) || '</body>' || chr(10) || '</html>'")
BINARY_BODY = "CASE WHEN code = 0 THEN rendered ELSE message END"

SQL["convert_requests"] = f"""SELECT request_id, code, rule, message, md5(rendered) AS data_md5, template_used,
  md5(CASE template_used WHEN 'binary' THEN {BINARY_BODY} WHEN 'render-html' THEN {EMBED} ELSE {DEFAULT_JSON} END)
    AS response_md5 FROM {OUTCOMES}"""
SQL["envelope"] = f"""SELECT request_id, code, message, code = 0 AS has_result, md5(rendered) AS data_md5
  FROM {OUTCOMES}"""
SQL["select_template"] = f"SELECT request_id, template, template_used FROM {OUTCOMES}"
SQL["render_default_json"] = f"SELECT request_id, md5({DEFAULT_JSON}) AS response_md5 FROM {OUTCOMES}"
SQL["render_embed_html"] = f"SELECT request_id, md5({EMBED}) AS response_md5 FROM {OUTCOMES}"
SQL["render_binary_body"] = f"""SELECT request_id, CAST(CASE WHEN code = 0 THEN 200 ELSE 400 END AS BIGINT) AS status,
  CASE WHEN code = 0 AND dst = 'pdf' THEN 'application/pdf' END AS content_type, md5({BINARY_BODY}) AS body_md5
  FROM {OUTCOMES}"""
SQL["outcome_summary"] = f"""SELECT driver, dst AS dst_format, code, rule, count(*) AS n FROM {OUTCOMES}
  GROUP BY ALL"""

VARS = """(SELECT doc_id, text, [split_part(text, chr(10), 1)] AS title_l,
    CASE WHEN doc_id % 7 <> 0 THEN [lang] ELSE [] END AS lang_l,
    CASE WHEN doc_id % 3 <> 0 THEN [source, 'editor-' || CAST(doc_id % 5 AS VARCHAR)] ELSE [source] END AS author_l,
    (CASE WHEN doc_id % 2 = 0 THEN string_split(text, ' ')[1:3] ELSE [] END)
      || (CASE WHEN doc_id % 11 = 0 THEN [''] ELSE [] END) AS kw_l
  FROM documents)"""


def _nonempty(lst: str) -> str:
    return f"(len(list_filter({lst}, lambda x: x <> '')) > 0)"


SQL["template_render"] = f"""SELECT doc_id, md5(r) AS rendered_md5, CAST(length(r) AS BIGINT) AS n_chars FROM (
  SELECT doc_id,
    CASE WHEN {_nonempty('title_l')} THEN '# ' || array_to_string(title_l, '') || chr(10) ELSE '' END
    || 'By ' || array_to_string(author_l, ', ') || '.' || chr(10)
    || CASE WHEN {_nonempty('kw_l')} THEN 'Keywords: ' || array_to_string(list_transform(kw_l,
         lambda k: '[' || k || ']'), '; ') ELSE 'No keywords' END || chr(10)
    || CASE WHEN {_nonempty('lang_l')} THEN CASE WHEN {_nonempty('author_l')} THEN 'lang=' || array_to_string(lang_l, '')
         || ' by ' || array_to_string(author_l, '') ELSE 'lang only' END ELSE '' END || chr(10)
    || array_to_string(list_transform(author_l, lambda a: CASE WHEN a <> '' THEN '<' || a || '>' ELSE '' END), '')
    || ' $5 |y' || chr(10) || text AS r
  FROM {VARS})"""

INC = """(SELECT lang, '<meta name="lang" content="' || lang || '">' AS header,
    '<p>Start ' || lang || ' (' || CAST(count(*) AS VARCHAR) || ')</p>' AS before, '<p>End</p>' AS after
  FROM documents GROUP BY lang)"""
SQL["includes"] = f"""SELECT d.doc_id, md5({page("split_part(d.text, chr(10), 1)", "i.header",
                                                 "concat_ws(chr(10), i.before, coalesce(h.content, ''), i.after)")})
    AS page_md5
  FROM documents d LEFT JOIN {INC} i ON i.lang = d.lang
  LEFT JOIN {S.render_html_agg(S.plain_blocks(DOCS))} h ON h.doc_id = d.doc_id"""

META_LONG = """(SELECT doc_id, 'title' AS key, split_part(text, chr(10), 1) AS value, 3 AS priority, 0 AS ord FROM documents
  UNION ALL SELECT doc_id, 'lang', lang, 3, 0 FROM documents
  UNION ALL SELECT doc_id, 'source', source, 3, 0 FROM documents
  UNION ALL SELECT doc_id, 'quality', CAST(quality AS VARCHAR), 2, 0 FROM labels
  UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR), 2, 0 FROM labels
  UNION ALL SELECT doc_id, 'lang', 'xx', 2, 0 FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'title', 'Request ' || CAST(doc_id AS VARCHAR), 1, 0 FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'tags', lang, 1, 0 FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'tags', source, 1, 1 FROM documents WHERE doc_id % 2 = 0)"""
SQL["merge_metadata"] = f"""SELECT doc_id, key, CAST(p AS BIGINT) AS source_priority, count(*) AS n_values,
  string_agg(CASE WHEN key = 'title' THEN 'Corpus - ' || value ELSE value END, '|' ORDER BY ord, value) AS value
  FROM (SELECT *, min(priority) OVER (PARTITION BY doc_id, key) AS p FROM {META_LONG}) WHERE priority = p
  GROUP BY doc_id, key, p"""
SQL["convert_distinct"] = f"""SELECT d.doc_id, md5(coalesce(h.content, '')) AS content_md5 FROM documents d
  LEFT JOIN {S.render_html_agg(S.plain_blocks(DOCS))} h ON h.doc_id = d.doc_id"""

# --- the conversion job with per-request options (markdown documents) ---------------------------------------------

from quire.operators.normalize import NON_ASCII_RE  # noqa: E402
from quire.plans.oracle import MD_DOCS  # noqa: E402

_MD_BLOCKS = S.markdown_blocks(MD_DOCS)
_RUN = "PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_CUMS = ", ".join(f"sum(CASE WHEN kind = 'heading' AND level = {k} THEN 1 ELSE 0 END) OVER ({_RUN}) AS cum{k}"
                  for k in range(1, 7))
_BASES = ", ".join(
    f"coalesce(last_value(CASE WHEN kind = 'heading' AND level < {k} THEN cum{k} END IGNORE NULLS) OVER ({_RUN}), 0)"
    f" AS base{k}" for k in range(2, 7))
_NUM = ("array_to_string(list_slice([CAST(cum1 + doc_id % 2 AS VARCHAR), " +
        ", ".join(f"CAST(cum{k} - base{k} AS VARCHAR)" for k in range(2, 7)) + "], 1, level), '.')")
OPT_BLOCKS = f"""(SELECT doc_id, block_no, kind, level,
    CASE WHEN kind = 'heading' AND doc_id % 3 = 0 THEN {_NUM} || ' ' || text ELSE text END AS text
  FROM (SELECT *, {_BASES} FROM (SELECT *, {_CUMS} FROM {_MD_BLOCKS})))"""
OPT_RENDERED = f"""(SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN coalesce(m.content, '')
    ELSE coalesce(h.content, '') END AS r
  FROM documents d LEFT JOIN {S.render_markdown_agg(OPT_BLOCKS, atx=True)} m ON m.doc_id = d.doc_id
  LEFT JOIN {S.render_html_agg(OPT_BLOCKS)} h ON h.doc_id = d.doc_id)"""
_ASCII = S.zip_tokens(OPT_RENDERED, "doc_id, r", "r", NON_ASCII_RE, S.char_ref("tk"), "a")
SQL["convert_options"] = f"""SELECT doc_id AS request_id, CAST(0 AS BIGINT) AS code,
  md5(CASE WHEN doc_id % 5 = 0 THEN {S.eol_crlf('t')} ELSE t END) AS data_md5
  FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN a ELSE r END AS t FROM {_ASCII})"""

# toc items (block_no 0, in heading order) go before the blocks of every even request, whatever the output
_TOC = f"""(SELECT doc_id, 0 AS block_no, block_no AS ord2, 'item' AS kind, level, repeat('  ', level - 1) || text AS text
  FROM {_MD_BLOCKS} WHERE kind = 'heading' AND level <= 2 AND doc_id % 2 = 0)"""
_ALL = f"""(SELECT doc_id, block_no, block_no AS ord2, kind, level, text FROM {_MD_BLOCKS}
  UNION ALL SELECT * FROM {_TOC})"""
# markdown rows: paragraph lines joined for wrap none
_MD_OPT = f"""(SELECT doc_id, block_no, ord2, kind, level,
    CASE WHEN kind = 'para' AND doc_id % 4 = 1 THEN replace(text, chr(10), ' ') ELSE text END AS text
  FROM {_ALL} WHERE doc_id % 3 <> 0)"""
_MD_OUT = f"""(SELECT doc_id, coalesce(string_agg({S.markdown_piece(True)}, {S.NL2} ORDER BY block_no, ord2)
    FILTER (WHERE text <> ''), '') AS content FROM {_MD_OPT} GROUP BY doc_id)"""
# html rows: ids on the non-empty headings when the id is even
_SLUGGED = f"""(SELECT *, CASE WHEN s3 = '' THEN 'section' ELSE s3 END AS slug
  FROM (SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(lower(text), '[^a-z0-9_ -]', '', 'g')), ' +',
          '-', 'g'), '^[^a-z]+', '') AS s3 FROM {_ALL} WHERE doc_id % 3 = 0 AND text <> ''))"""
_IDS = f"""(SELECT *, CASE WHEN kind = 'heading' AND doc_id % 2 = 0 THEN 'x-' || CASE WHEN n = 0 THEN slug
      ELSE slug || '-' || CAST(n AS VARCHAR) END END AS hid
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind = 'heading', slug ORDER BY block_no, ord2) - 1 AS n
        FROM {_SLUGGED}))"""
_ESC = S.html_escape("text")
_HTML_OUT = f"""(SELECT doc_id, coalesce(string_agg(piece, chr(10) ORDER BY block_no, ord2), '') AS content FROM (
    SELECT doc_id, block_no, ord2,
      CASE WHEN kind = 'item' AND coalesce(prev_k, '') <> 'item' THEN '<ul>' || chr(10) ELSE '' END ||
      CASE WHEN kind = 'heading' THEN '<h' || level || CASE WHEN hid IS NULL THEN '' ELSE ' id="'
             || {S.html_escape('hid')} || '"' END || '>' || {_ESC} || '</h' || level || '>'
           WHEN kind = 'item' THEN '<li>' || {_ESC} || '</li>' ELSE '<p>' || {_ESC} || '</p>' END ||
      CASE WHEN kind = 'item' AND coalesce(next_k, '') <> 'item' THEN chr(10) || '</ul>' ELSE '' END AS piece
    FROM (SELECT *, lag(kind) OVER w AS prev_k, lead(kind) OVER w AS next_k FROM {_IDS}
          WINDOW w AS (PARTITION BY doc_id ORDER BY block_no, ord2)))
  GROUP BY doc_id)"""
SQL["convert_options_2"] = f"""SELECT d.doc_id AS request_id, CAST(0 AS BIGINT) AS code,
  md5(CASE WHEN d.doc_id % 3 = 0 THEN coalesce(h.content, '') ELSE coalesce(m.content, '') END) AS data_md5
  FROM documents d LEFT JOIN {_MD_OUT} m ON m.doc_id = d.doc_id LEFT JOIN {_HTML_OUT} h ON h.doc_id = d.doc_id"""

# html with sections: shifted levels (base 2 when id % 5 = 0), numbers when the id is even, sections closed by count
_SHIFTED = f"""(SELECT doc_id, block_no, CASE WHEN kind = 'heading' AND doc_id % 5 = 0 AND level + 1 > 6 THEN 'para'
      ELSE kind END AS kind,
    CASE WHEN kind = 'heading' AND doc_id % 5 = 0 AND level + 1 > 6 THEN 0
         WHEN kind = 'heading' AND doc_id % 5 = 0 THEN level + 1 ELSE level END AS level, text FROM {_MD_BLOCKS})"""
_CUMS3 = ", ".join(f"sum(CASE WHEN kind = 'heading' AND level = {k} THEN 1 ELSE 0 END) OVER ({_RUN}) AS cum{k}"
                   for k in range(1, 7))
_NUM3 = ("array_to_string(list_slice([CAST(cum1 AS VARCHAR), " +
         ", ".join(f"CAST(cum{k} - base{k} AS VARCHAR)" for k in range(2, 7)) + "], 1, level), '.')")
_NUMBERED = f"""(SELECT doc_id, block_no, kind, level,
    CASE WHEN kind = 'heading' AND doc_id % 2 = 0 THEN {_NUM3} || ' ' || text ELSE text END AS text
  FROM (SELECT *, {_BASES} FROM (SELECT *, {_CUMS3} FROM {_SHIFTED})))"""
_KEPT = f"(SELECT * FROM {_NUMBERED} WHERE text <> '')"
_HEADS = f"(SELECT doc_id, block_no, level FROM {_KEPT} WHERE kind = 'heading')"
_CLOSES = f"""(SELECT j.doc_id, j.block_no, count(t.block_no) AS closes FROM {_HEADS} j
  LEFT JOIN {_HEADS} t ON t.doc_id = j.doc_id AND t.block_no < j.block_no AND t.level >= j.level
    AND NOT EXISTS (SELECT 1 FROM {_HEADS} c WHERE c.doc_id = j.doc_id AND c.block_no > t.block_no
                    AND c.block_no < j.block_no AND c.level <= t.level)
  GROUP BY j.doc_id, j.block_no)"""
_OPEN_END = f"""(SELECT t.doc_id, count(*) AS open_end FROM {_HEADS} t
  WHERE NOT EXISTS (SELECT 1 FROM {_HEADS} c WHERE c.doc_id = t.doc_id AND c.block_no > t.block_no
                    AND c.level <= t.level) GROUP BY t.doc_id)"""
_SEC_HTML = f"""(SELECT k.doc_id, coalesce(string_agg(piece, chr(10) ORDER BY k.block_no), '') AS content FROM (
    SELECT b.doc_id, b.block_no,
      CASE WHEN kind = 'item' AND coalesce(prev_k, '') <> 'item' THEN '<ul>' || chr(10) ELSE '' END ||
      CASE WHEN kind = 'heading' THEN repeat('</section>' || chr(10), CAST(c.closes AS INTEGER)) || '<section>'
             || chr(10) || '<h' || level || '>' || {_ESC} || '</h' || level || '>'
           WHEN kind = 'item' THEN '<li>' || {_ESC} || '</li>' ELSE '<p>' || {_ESC} || '</p>' END ||
      CASE WHEN kind = 'item' AND coalesce(next_k, '') <> 'item' THEN chr(10) || '</ul>' ELSE '' END AS piece
    FROM (SELECT *, lag(kind) OVER w AS prev_k, lead(kind) OVER w AS next_k FROM {_KEPT}
          WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)) b
    LEFT JOIN {_CLOSES} c ON c.doc_id = b.doc_id AND c.block_no = b.block_no) k
  GROUP BY k.doc_id)"""
SQL["convert_options_3"] = f"""SELECT d.doc_id AS request_id, CAST(0 AS BIGINT) AS code,
  md5(coalesce(h.content, '') || repeat(chr(10) || '</section>', CAST(coalesce(o.open_end, 0) AS INTEGER)))
    AS data_md5
  FROM documents d LEFT JOIN {_SEC_HTML} h ON h.doc_id = d.doc_id LEFT JOIN {_OPEN_END} o ON o.doc_id = d.doc_id"""

# input and output text stages
from quire.operators.normalize import COMMENT_RE, EMAIL_RE  # noqa: E402

_MARKED = f"""(SELECT doc_id, '<ins>ADD</ins><del>DEL</del> <!-- note --> '
    || regexp_replace(content, '^([^ \\n]*) ', '\\1' || chr(9)) AS content FROM {MD_DOCS})"""
_S1 = f"""(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(content, {S.q(COMMENT_RE)}, '', 'g')
    ELSE content END AS c1 FROM {_MARKED})"""
_S2 = f"""(SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {S.track('c1', 'accept')} WHEN doc_id % 4 = 1
    THEN {S.track('c1', 'reject')} ELSE c1 END AS c2 FROM {_S1})"""
_S3 = f"""(SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN c2 ELSE {S.expand_tabs('c2')} END AS content FROM {_S2})"""
_B4 = f"""(SELECT doc_id, block_no, kind, level,
    CASE WHEN kind = 'para' AND doc_id % 2 = 0 AND doc_id % 7 = 0 THEN {S.wrap_auto('text', 40)} ELSE text END
      AS text FROM {S.markdown_blocks(_S3)})"""
_R4 = f"""(SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN coalesce(m.content, '') ELSE coalesce(h.content, '') END AS r
  FROM documents d LEFT JOIN {S.render_markdown_agg(_B4, atx=False)} m ON m.doc_id = d.doc_id
  LEFT JOIN {S.render_html_agg(_B4)} h ON h.doc_id = d.doc_id)"""
_ENC = f"array_to_string(list_transform(string_split(tk, ''), lambda c: {S.char_ref('c')}), '')"
_E4 = S.zip_tokens(_R4, "doc_id, r", "r", EMAIL_RE, _ENC, "e")
SQL["convert_options_4"] = f"""SELECT doc_id AS request_id, CAST(0 AS BIGINT) AS code,
  md5(CASE WHEN doc_id % 2 = 1 AND doc_id % 5 = 0 THEN e ELSE r END) AS data_md5 FROM {_E4}"""

# html input with reference-link notes
from quire.plans.oracle import PAGES  # noqa: E402
from quire.plans.oracle_links import LINKS  # noqa: E402

_BL5 = S.html_blocks(PAGES)
_SEC5 = f"""(SELECT doc_id, block_no, kind, level, text,
    sum(CASE WHEN kind = 'heading' AND level <= 1 THEN 1 ELSE 0 END) OVER ({_RUN}) AS sec FROM {_BL5})"""
_LKS = f"""(SELECT l.doc_id, l.n, l.block_no, l.href, coalesce(s.sec, 0) AS sec FROM {LINKS} l
  LEFT JOIN {_SEC5} s ON s.doc_id = l.doc_id AND s.block_no = l.block_no)"""


def _notes_by(keys: str) -> str:
    return f"""(SELECT {keys}, string_agg('[' || CAST(k AS VARCHAR) || ']: ' || href, chr(10) ORDER BY k) AS notes
  FROM (SELECT {keys}, href, row_number() OVER (PARTITION BY {keys} ORDER BY first_n) AS k
        FROM (SELECT {keys}, href, min(n) AS first_n FROM {_LKS} GROUP BY {keys}, href)) GROUP BY {keys})"""


_KEPT5 = f"""(SELECT *, {S.markdown_piece(False)} AS piece,
    block_no = max(block_no) OVER (PARTITION BY doc_id, sec) AS last_of_sec FROM {_SEC5} WHERE text <> '')"""
_MD5 = f"""(SELECT k.doc_id, CASE
      WHEN k.doc_id % 3 = 0 THEN concat_ws({S.NL2}, string_agg(k.piece, {S.NL2} ORDER BY k.block_no), max(dn.notes))
      WHEN k.doc_id % 3 = 1 THEN string_agg(concat_ws({S.NL2}, k.piece, bn.notes), {S.NL2} ORDER BY k.block_no)
      ELSE string_agg(CASE WHEN k.last_of_sec THEN concat_ws({S.NL2}, k.piece, sn.notes) ELSE k.piece END, {S.NL2}
                      ORDER BY k.block_no) END AS content
  FROM {_KEPT5} k
  LEFT JOIN {_notes_by('doc_id')} dn ON dn.doc_id = k.doc_id
  LEFT JOIN {_notes_by('doc_id, block_no')} bn ON bn.doc_id = k.doc_id AND bn.block_no = k.block_no
  LEFT JOIN {_notes_by('doc_id, sec')} sn ON sn.doc_id = k.doc_id AND sn.sec = k.sec
  GROUP BY k.doc_id)"""
SQL["convert_options_5"] = f"""SELECT p.page_id AS request_id,
  CAST(CASE WHEN failed THEN 400 ELSE 0 END AS BIGINT) AS code,
  CASE WHEN failed THEN 'failing because there were warnings: html_unclosed' ELSE '' END AS message,
  CASE WHEN failed THEN NULL WHEN p.page_id % 2 = 0 THEN md5(coalesce(m.content, ''))
       ELSE md5(coalesce(t.content, '')) END AS data_md5
  FROM (SELECT *, page_id % 4 = 3 AND NOT contains(lower(html), '</body>') AS failed FROM pages) p
  LEFT JOIN {_MD5} m ON m.doc_id = p.page_id
  LEFT JOIN {S.render_plain_agg(_BL5)} t ON t.doc_id = p.page_id"""

# standalone through the job's document template, variables from the request
_MDB6 = S.markdown_blocks(MD_DOCS)
_TITLE = """CASE WHEN d.doc_id % 2 = 0 THEN CASE WHEN d.doc_id % 5 = 0 THEN 'P - ' ELSE '' END || 'T'
  || CAST(d.doc_id AS VARCHAR) WHEN d.doc_id % 5 = 0 THEN 'P' ELSE '' END"""
SQL["convert_options_6"] = f"""SELECT d.doc_id AS request_id, CAST(0 AS BIGINT) AS code,
  md5({_TITLE} || '|' || CASE WHEN d.doc_id % 3 = 0 THEN 'a' || CAST(d.doc_id % 3 AS VARCHAR) || ', b' ELSE '' END
      || '|' || CASE WHEN d.doc_id % 3 = 0 THEN d.lang ELSE 'none' END || '|'
      || CASE WHEN d.doc_id % 2 = 0 THEN coalesce(m.content, '') ELSE coalesce(h.content, '') END) AS data_md5
  FROM documents d LEFT JOIN {S.render_markdown_agg(_MDB6, atx=False)} m ON m.doc_id = d.doc_id
  LEFT JOIN {S.render_html_agg(_MDB6)} h ON h.doc_id = d.doc_id"""

# extract_media in the job (per-row folder and default extension), built-in standalone page with css
from quire.operators.media import INLINE_URI_RE  # noqa: E402
from quire.plans.oracle_links import MEDIA_DOCS, ext as _mime_ext  # noqa: E402

_MDB7 = S.markdown_blocks(MEDIA_DOCS)
_CSS = "'<link rel=\"stylesheet\" href=\"s.css\">'"
_R7 = f"""(SELECT d.doc_id,
    CASE WHEN d.doc_id % 3 = 0 THEN 'm' WHEN d.doc_id % 3 = 1 THEN 'media/sub/' ELSE '' END AS dir__,
    CASE WHEN d.doc_id % 5 = 0 THEN 'dat' ELSE 'bin' END AS ext__,
    CASE WHEN d.doc_id % 2 = 0 THEN coalesce(m.content, '')
         WHEN d.doc_id % 7 = 0 THEN {page("''", _CSS, "coalesce(h.content, '')")}
         ELSE coalesce(h.content, '') END AS r
  FROM documents d LEFT JOIN {S.render_markdown_agg(_MDB7, atx=False)} m ON m.doc_id = d.doc_id
  LEFT JOIN {S.render_html_agg(_MDB7)} h ON h.doc_id = d.doc_id)"""
_U7 = S.q(INLINE_URI_RE)
_TYPE = f"regexp_extract(tk, {_U7}, 1)"
_REF7 = (f"rtrim(dir__, '/') || '/' || md5(from_base64(regexp_extract(tk, {_U7}, 2))) || "
         f"coalesce(nullif(replace({_mime_ext(_TYPE)}, '.bin', ''), ''), '.' || ext__)")
_X7 = S.zip_tokens(_R7, "doc_id, dir__, ext__, r", "r", INLINE_URI_RE, _REF7, "x")
SQL["convert_options_7"] = f"""SELECT doc_id AS request_id, CAST(0 AS BIGINT) AS code,
  md5(CASE WHEN dir__ <> '' AND len(regexp_extract_all(r, {_U7}, 0)) > 0 THEN x ELSE r END) AS data_md5 FROM {_X7}"""

# self_contained: the original documents for rows with the option, the M1-rewritten ones for the others
from quire.plans.oracle_links import _MEDIA_REF  # noqa: E402

_REWRITTEN = S.zip_tokens(f"(SELECT doc_id, content AS c FROM {MEDIA_DOCS})", "doc_id, c", "c", INLINE_URI_RE,
                          _MEDIA_REF.replace("'media/'", "'m/'"), "r")
_SC_SRC = f"""(SELECT doc_id, CASE WHEN doc_id % 3 <> 0 OR len(regexp_extract_all(c, {_U7}, 0)) = 0 THEN c ELSE r END
    AS content FROM {_REWRITTEN})"""
_SC_BLOCKS = S.markdown_blocks(_SC_SRC)
SQL["convert_self_contained"] = f"""SELECT d.doc_id AS request_id, CAST(0 AS BIGINT) AS code,
  md5(CASE WHEN d.doc_id % 2 = 0 THEN coalesce(m.content, '') ELSE coalesce(h.content, '') END) AS data_md5
  FROM documents d LEFT JOIN {S.render_markdown_agg(_SC_BLOCKS, atx=False)} m ON m.doc_id = d.doc_id
  LEFT JOIN {S.render_html_agg(_SC_BLOCKS)} h ON h.doc_id = d.doc_id"""
