"""Oracle SQL for the storage-backed queries (stream = batch; the sink and side files read back)."""

from __future__ import annotations

from quire.plans.oracle import SQL
from quire.plans.oracle_outline import MD_BLOCKS
from quire.plans.oracle_results import OUTCOMES

SQL["convert_stream"] = SQL["convert_requests"]
SQL["write_documents"] = f"""SELECT request_id, CAST(request_id AS VARCHAR) || '.' || dst AS name, dst AS dst_format,
  CAST(octet_length(encode(rendered)) AS BIGINT) AS n_bytes, md5(rendered) AS content_md5
  FROM {OUTCOMES} WHERE code = 0"""
SQL["fetch_files"] = """SELECT item_id, item_id % 3 <> 0 AS ok,
  CASE WHEN item_id % 3 <> 0 THEN md5(text || chr(10)) END AS content_md5 FROM benchmark"""
SQL["block_filter"] = f"""SELECT doc_id, block_no, kind, level,
  CASE WHEN kind = 'heading' THEN '§ ' || text ELSE text END AS text FROM {MD_BLOCKS} WHERE kind <> 'item'"""
SQL["read_requests_stream"] = SQL["read_requests"].replace("SELECT request_id, bad AS bad_json", "SELECT bad AS bad_json", 1)

from quire.plans import sqlparts as S  # noqa: E402
from quire.plans.oracle import MD_DOCS  # noqa: E402
from quire.plans.oracle_results import page  # noqa: E402

_MDB = S.markdown_blocks(MD_DOCS)
SQL["convert_with_files"] = f"""SELECT d.doc_id AS request_id, CAST(0 AS BIGINT) AS code,
  md5({page("''", "CASE WHEN d.doc_id % 3 = 0 THEN b.text || chr(10) ELSE '' END",
            "concat_ws(chr(10), b.text || chr(10), coalesce(h.content, ''))")}) AS data_md5
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
  LEFT JOIN {S.render_html_agg(_MDB)} h ON h.doc_id = d.doc_id"""
