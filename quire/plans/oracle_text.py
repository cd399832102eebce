"""Oracle SQL, step 3: rendering and normalisation stages."""

from __future__ import annotations

from quire.operators.normalize import COMMENT_RE, EMAIL_RE, NON_ASCII_RE, abbreviation_pattern
from quire.plans import sqlparts as S
from quire.plans.oracle import MD_DOCS, PAGES, SQL
from quire.plans.queries_text import ABBREVIATIONS

TABBED = """(SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN i = 1
    THEN w WHEN (i - 1) % 3 = 0 THEN chr(9) || w ELSE ' ' || w END), '') AS content FROM benchmark)"""
TRACKED = r"""(SELECT item_id, regexp_replace(text, '^(\S+) (\S+)', '<ins>\1</ins> <del>\2</del>') AS content
  FROM benchmark)"""
ABBR_RE = S.q(abbreviation_pattern(ABBREVIATIONS))


def ascii_sql(src: str, keep: str, col: str, out: str) -> str:
    z = S.zip_tokens(src, keep, col, NON_ASCII_RE, S.char_ref("tk"), "z__")
    return f"(SELECT {keep}, z__ AS {out} FROM {z})"


def email_sql(src: str, keep: str, col: str, out: str) -> str:
    enc = f"array_to_string(list_transform(string_split(tk, ''), lambda c: {S.char_ref('c')}), '')"
    return S.zip_tokens(src, keep, col, EMAIL_RE, enc, out)


SQL["strip_comments"] = f"""SELECT doc_id, md5(s) AS content_md5, CAST(length(content) - length(s) AS BIGINT)
  AS n_removed FROM (SELECT doc_id, content, regexp_replace(content, {S.q(COMMENT_RE)}, '', 'g') AS s FROM {PAGES})"""
SQL["html_to_markdown"] = (
    f"SELECT doc_id, md5(content) AS content_md5 FROM "
    f"{S.render_markdown_agg(S.strip_empty(S.html_blocks(PAGES)), atx=False)}"
)
SQL["markdown_atx"] = f"""SELECT d.doc_id, md5(coalesce(c.content, '')) AS content_md5 FROM {MD_DOCS} d
  LEFT JOIN {S.render_markdown_agg(S.markdown_blocks(MD_DOCS), atx=True)} c ON c.doc_id = d.doc_id"""
SQL["text_to_html"] = f"SELECT doc_id, md5(content) AS content_md5 FROM {S.render_html_agg(S.markdown_blocks(MD_DOCS))}"
SQL["expand_tabs"] = f"""SELECT item_id, md5(e) AS content_md5, CAST(length(e) AS BIGINT) AS n_chars
  FROM (SELECT item_id, {S.expand_tabs('content')} AS e FROM {TABBED})"""
SQL["eol_crlf"] = f"""SELECT doc_id, md5(e) AS content_md5, CAST(length(e) AS BIGINT) AS n_chars
  FROM (SELECT doc_id, {S.eol_crlf('text')} AS e FROM documents)"""
SQL["wrap_auto"] = f"""SELECT doc_id, md5(w) AS content_md5, CAST(len(string_split(w, chr(10))) AS BIGINT) AS n_lines,
  CAST(list_max(list_transform(string_split(w, chr(10)), lambda x: length(x))) AS BIGINT) AS max_line
  FROM (SELECT doc_id, {S.wrap_auto('text')} AS w FROM documents)"""
SQL["wrap_none"] = f"SELECT doc_id, md5({S.wrap_none('text')}) AS content_md5 FROM documents"
SQL["ascii_refs"] = f"""SELECT doc_id, md5(a) AS content_md5, CAST(length(a) AS BIGINT) AS n_chars
  FROM {ascii_sql('documents', 'doc_id', 'text', 'a')}"""
SQL["email_refs"] = f"SELECT doc_id, md5(e) AS content_md5 FROM {email_sql('documents', 'doc_id', 'text', 'e')}"
SQL["abbreviations"] = f"""SELECT doc_id, md5(regexp_replace(text, {ABBR_RE}, '\\1' || chr(160), 'g')) AS content_md5
  FROM documents"""
SQL["track_accept"] = f"SELECT item_id, {S.track('content', 'accept')} AS content FROM {TRACKED}"
SQL["track_reject"] = f"SELECT item_id, {S.track('content', 'reject')} AS content FROM {TRACKED}"


def normalized(keep: str) -> str:
    """Stages in the order of ``NORMALIZE_OPTS``: track_changes, expand_tabs, abbreviations, email, ascii, wrap, eol."""
    s1 = f"(SELECT {keep}, s0, {S.track('s0', 'accept')} AS s1 FROM (SELECT {keep}, text AS s0 FROM documents))"
    s2 = f"(SELECT *, {S.expand_tabs('s1')} AS s2 FROM {s1})"
    s3 = f"(SELECT *, regexp_replace(s2, {ABBR_RE}, '\\1' || chr(160), 'g') AS s3 FROM {s2})"
    s4 = email_sql(s3, f"{keep}, s0, s1, s2, s3", "s3", "s4")
    s5 = ascii_sql(s4, f"{keep}, s0, s1, s2, s3, s4", "s4", "s5")
    s6 = f"(SELECT *, {S.wrap_auto('s5')} AS s6 FROM {s5})"
    s7 = f"(SELECT *, {S.eol_lf('s6')} AS s7 FROM {s6})"
    names = ["track_changes", "expand_tabs", "abbreviations", "email_obfuscation", "ascii", "wrap", "eol"]
    flags = ", ".join(f"CASE WHEN s{k} <> s{k - 1} THEN '{n}' END" for k, n in enumerate(names, start=1))
    return f"(SELECT {keep}, s7 AS content, list_filter([{flags}], lambda x: x IS NOT NULL) AS changed FROM {s7})"


SQL["normalize_corpus"] = f"""SELECT doc_id, md5(content) AS content_md5, array_to_string(changed, ',') AS changed
  FROM {normalized('doc_id')}"""
SQL["normalize_summary"] = f"""SELECT source, stage, count(*) AS n_docs
  FROM (SELECT source, unnest(changed) AS stage FROM {normalized('doc_id, source')}) GROUP BY source, stage"""
