"""Oracle SQL (DuckDB dialect) for the registered queries; views of the test tables are pre-registered."""

from __future__ import annotations

from quire.functions.codecs import ENTITY_RE
from quire.plans import sqlparts as S

PAGES = "(SELECT page_id AS doc_id, html AS content FROM pages)"
DOCS = "(SELECT doc_id, text AS content FROM documents)"
MD_DOCS = (
    "(SELECT doc_id, '# Document ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || "
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^E', '- E', 'g'), '(?m)^A', "
    "chr(10) || 'A', 'g'), '(?m)^T', '## T', 'g'), '(?m)^O', '### O', 'g') AS content FROM documents)"
)
BAD_PAYLOADS = """(SELECT doc_id, source, CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 17 = 0 THEN '$' || p
      WHEN doc_id % 13 = 0 AND ends_with(p, '=') THEN substr(p, 1, length(p) - 1) ELSE p END AS payload
    FROM (SELECT doc_id, source, to_base64(encode(text)) AS p FROM documents))"""
DECODED = f"""(SELECT doc_id, source, ok, CASE WHEN ok THEN from_base64(payload) END AS data
    FROM (SELECT *, {S.b64_valid('payload')} AS ok FROM {BAD_PAYLOADS}))"""

SQL: dict[str, str] = {}

SQL["html_blocks"] = f"SELECT * FROM {S.html_blocks(PAGES)}"
SQL["strip_empty"] = f"SELECT * FROM {S.strip_empty(S.html_blocks(PAGES))}"
SQL["html_to_plain"] = f"SELECT * FROM {S.render_plain_agg(S.strip_empty(S.html_blocks(PAGES)))}"
SQL["convert_pages"] = f"""
SELECT doc_id, CAST(CASE WHEN failed THEN 400 ELSE 0 END AS BIGINT) AS code, message,
  CAST(CASE WHEN failed THEN 0 ELSE length(content) END AS BIGINT) AS n_chars,
  md5(CASE WHEN failed THEN '{{"code":400,"message":' || to_json(message) || '}}'
      ELSE '{{"code":0,"message":"","result":{{"data":"' || to_base64(encode(content)) || '"}}}}' END) AS response_md5
FROM (SELECT p.page_id AS doc_id, p.page_id % 10 = 0 AS failed, coalesce(c.content, '') AS content,
        CASE WHEN p.page_id % 10 = 0 THEN '[fetcher-http]: fetch url by GET failure <' || p.url
          || '>, status code is 404' ELSE '' END AS message
      FROM pages p LEFT JOIN {S.render_plain_agg(S.strip_empty(S.html_blocks(PAGES)))} c ON c.doc_id = p.page_id)"""
SQL["text_blocks"] = f"SELECT * FROM {S.plain_blocks(DOCS)}"
SQL["markdown_blocks"] = f"SELECT * FROM {S.markdown_blocks(MD_DOCS)}"
SQL["encode_corpus"] = """SELECT doc_id, to_base64(encode(text)) AS payload,
  CAST(length(to_base64(encode(text))) AS BIGINT) AS payload_chars FROM documents"""
SQL["decode_corpus"] = f"SELECT doc_id, source, ok, md5(data) AS data_md5 FROM {DECODED}"
SQL["decode_summary"] = f"""SELECT source, count(*) AS n_rows,
  CAST(sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) AS BIGINT) AS n_rejected,
  CAST(sum(coalesce(octet_length(data), 0)) AS BIGINT) AS decoded_bytes FROM {DECODED} GROUP BY source"""
SQL["export_json"] = f"""SELECT {S.json_safe("to_json(struct_pack(event_id := event_id, user_id := user_id, "
                                              "event_type := event_type, props := props))")} AS json FROM events"""
SQL["duplicate_groups"] = """SELECT md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars,
  count(*) AS n_docs, min(doc_id) AS kept_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1"""
SQL["byte_profile"] = """SELECT lang, source, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes,
  CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang, source"""
SQL["escape_corpus"] = f"""SELECT page_id AS doc_id, md5({S.html_escape('html')}) AS escaped_md5,
  CAST(length(html) - length(regexp_replace(html, '[&''<>"]', '', 'g')) AS BIGINT) AS n_replaced FROM pages"""
SQL["entity_inventory"] = f"""SELECT entity, n, {S.entity_cp('entity')} IS NOT NULL AS known,
  {S.entity_dec('entity')} AS decoded
FROM (SELECT entity, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, {S.q(ENTITY_RE)}, 0)) AS entity
      FROM pages) GROUP BY entity)"""
SQL["unescape_corpus"] = f"SELECT doc_id, md5(decoded) AS decoded_md5 FROM {S.unescape(PAGES, 'doc_id', 'content', 'decoded')}"


# --- step 2 ------------------------------------------------------------------------------------------------------

from quire.model import MIME_EXT, OPTION_FIELDS, flag_name  # noqa: E402
from quire.sources.fetch import DATA_URI_RE  # noqa: E402

REQ_BODIES = """(SELECT request_id, CASE WHEN i % 41 = 0 THEN '' WHEN i % 37 = 0 THEN 'null'
      WHEN i % 31 = 0 THEN substr(f, 1, length(f) - 1) ELSE f END AS body
 FROM (SELECT i AS request_id, i, '{' || CASE WHEN i % 23 = 0 THEN '' ELSE '"fetcher":' || fetcher || ',' END
         || CASE WHEN i % 29 = 0 THEN '' ELSE '"converter":' || conv || ',' END || '"template":"' || tmpl || '"}' AS f
   FROM (SELECT i, '{"name":"' || name || '","params":' || CASE WHEN name = 'http' THEN '{"url":"'
           || coalesce(url, 'http://missing.example/' || CAST(i % (SELECT count(*) * 6 // 5 FROM pages) AS VARCHAR)) || '","method":"get"}'
           ELSE '{"data":"' || payload || '"}' END || '}' AS fetcher,
         '{"from":"' || CASE WHEN name = 'http' THEN 'html' ELSE 'plain' END || '","to":"'
           || CASE i % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' ELSE 'html' END || '"'
           || coalesce(',"data_dir":"' || dd || '"', '') || ',"standalone":' || CAST(i % 2 = 0 AS VARCHAR)
           || ',"toc":' || CAST(i % 3 = 0 AS VARCHAR) || ',"toc_depth":' || CAST(i % 5 AS VARCHAR)
           || ',"number_offset":' || CAST(i % 7 - 3 AS VARCHAR)
           || ',"filter":"' || CASE WHEN i % 5 = 0 THEN 'f.py' ELSE '' END || '"'
           || ',"variable":{"source":"' || source || '","lang":"' || lang || '"}'
           || ',"metadata":{"tags":["' || lang || '","' || source || '"]}}' AS conv,
         CASE i % 4 WHEN 0 THEN '' WHEN 1 THEN 'binary' WHEN 2 THEN 'render-html' ELSE 'nope' END AS tmpl
     FROM (SELECT d.doc_id AS i, d.lang, d.source, p.url,
             CASE d.doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'ftp' WHEN 2 THEN 'http' WHEN 3 THEN 'http'
               ELSE 'data' END AS name,
             CASE WHEN d.doc_id % 19 = 0 THEN '' WHEN d.doc_id % 17 = 0 THEN '$' || b
               WHEN d.doc_id % 13 = 0 AND ends_with(b, '=') THEN substr(b, 1, length(b) - 1) ELSE b END AS payload,
             CASE d.doc_id % 7 WHEN 0 THEN '/app/x' WHEN 1 THEN '/app2' WHEN 2 THEN '/app/../etc' END AS dd
           FROM (SELECT *, to_base64(encode(text)) AS b FROM documents) d
           LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) * 6 // 5 FROM pages)))))"""

PARSED = f"""(SELECT request_id, body, bad,
    CASE WHEN NOT bad THEN json_extract(body, '$.fetcher') END AS fet,
    CASE WHEN NOT bad THEN json_extract(body, '$.converter') END AS conv,
    CASE WHEN bad THEN '' ELSE coalesce(json_extract_string(body, '$.template'), '') END AS template
  FROM (SELECT request_id, body, (body IS NULL OR trim(body) = '' OR NOT json_valid(body)) AS bad
        FROM {REQ_BODIES}))"""


def normalize_path(p: str) -> str:
    stack = (f"list_reduce(string_split({p}, '/'), lambda acc, s: CASE WHEN s IN ('', '.') THEN acc "
             f"WHEN s = '..' THEN acc[1:len(acc) - 1] ELSE list_append(acc, s) END, []::VARCHAR[])")
    return f"(CASE WHEN starts_with({p}, '/') THEN '/' ELSE '' END || array_to_string({stack}, '/'))"


def safe(p: str, mode: str) -> str:
    if mode == "prefix":
        return f"starts_with({p}, '/app')"
    n = normalize_path(p)
    return f"({n} = '/app' OR starts_with({n}, '/app/'))"


def validated(mode: str = "strict") -> str:
    return f"""(SELECT *, CASE rule WHEN 1 THEN 'bad_json: request body is not a JSON object'
      WHEN 2 THEN 'converter options is nil' WHEN 3 THEN 'fetcher options is nil'
      WHEN 4 THEN 'DataDir: ''' || dd || ''' is not in safe dir: ''/app'''
      WHEN 5 THEN 'non input method, please check your fetcher options or uri param'
      WHEN 6 THEN 'fetcher ' || name || ' not exist' WHEN 7 THEN 'parse param failure'
      WHEN 8 THEN CASE WHEN name = 'data' THEN '[fetcher-data]: params of data is empty'
                       WHEN coalesce(purl, '') = '' THEN '[fetcher-http]: params of url is empty'
                       ELSE '[fetcher-http]: method ' || meth || ' not support' END END AS message
  FROM (SELECT *, CASE WHEN bad THEN 1 WHEN conv IS NULL THEN 2 WHEN fet IS NULL THEN 3
      WHEN coalesce(dd, '') <> '' AND NOT {safe('dd', mode)} THEN 4
      WHEN coalesce(name, '') = '' THEN 5 WHEN name NOT IN ('data', 'http') THEN 6
      WHEN name = 'data' AND (params IS NULL OR (pdata IS NOT NULL AND NOT {S.b64_valid('pdata')})) THEN 7
      WHEN name = 'http' AND params IS NULL THEN 7
      WHEN name = 'data' AND coalesce(pdata, '') = '' THEN 8
      WHEN name = 'http' AND (coalesce(purl, '') = '' OR meth NOT IN ('GET', 'POST')) THEN 8 END AS rule
    FROM (SELECT *, json_extract_string(conv, '$.data_dir') AS dd, json_extract_string(fet, '$.name') AS name,
            json_extract(fet, '$.params') AS params, json_extract_string(fet, '$.params.data') AS pdata,
            json_extract_string(fet, '$.params.url') AS purl,
            CASE WHEN coalesce(upper(json_extract_string(fet, '$.params.method')), '') = '' THEN 'GET'
                 ELSE upper(json_extract_string(fet, '$.params.method')) END AS meth
          FROM {PARSED})))"""


CRAWL = """(SELECT url AS c_url, 'GET' AS c_method, CASE WHEN page_id % 10 = 0 THEN 404 ELSE 200 END AS c_status,
    html AS c_body FROM pages)"""
SNAPSHOT = f"""(SELECT v.*, CASE WHEN c.c_url IS NULL THEN '[fetcher-http]: fetch url by ' || meth || ' failure <'
      || purl || '>, no snapshot' WHEN c.c_status <> 200 THEN '[fetcher-http]: fetch url by ' || meth || ' failure <'
      || purl || '>, status code is ' || CAST(c.c_status AS VARCHAR) END AS fetch_error,
    CASE WHEN c.c_url IS NOT NULL AND c.c_status = 200 THEN encode(c.c_body) END AS data
  FROM (SELECT * FROM {validated()} WHERE rule IS NULL AND name = 'http') v
  LEFT JOIN {CRAWL} c ON c.c_url = v.purl AND c.c_method = v.meth)"""
INLINE = f"""(SELECT *, CAST(NULL AS VARCHAR) AS fetch_error, from_base64(pdata) AS data
  FROM {validated()} WHERE rule IS NULL AND name = 'data')"""
FETCHED = f"""(SELECT request_id, name, rule, message, fetch_error, data FROM {SNAPSHOT}
  UNION ALL SELECT request_id, name, rule, message, fetch_error, data FROM {INLINE}
  UNION ALL SELECT request_id, name, rule, message, NULL, NULL FROM {validated()} WHERE rule IS NOT NULL)"""

SQL["read_requests"] = f"""SELECT request_id, bad AS bad_json, fet IS NOT NULL AS has_fetcher,
  conv IS NOT NULL AS has_converter, json_extract_string(fet, '$.name') AS fetcher_name,
  json_extract_string(conv, '$.from') AS src_format, json_extract_string(conv, '$.to') AS dst_format,
  json_extract_string(conv, '$.data_dir') AS data_dir, CAST(json_extract_string(conv, '$.toc_depth') AS BIGINT)
  AS toc_depth, template FROM {PARSED}"""
_RULE_VIEW = """SELECT request_id, CAST(coalesce(rule, 0) AS BIGINT) AS rule,
  CAST(CASE WHEN rule IS NULL THEN 0 ELSE 400 END AS BIGINT) AS code, coalesce(message, '') AS message FROM """
SQL["validate_requests"] = _RULE_VIEW + validated("strict")
SQL["validate_requests_prefix"] = _RULE_VIEW + validated("prefix")
SQL["fetch_inline"] = f"""SELECT request_id, true AS ok, md5(data) AS data_md5,
  CAST(octet_length(data) AS BIGINT) AS n_bytes FROM {INLINE}"""
SQL["fetch_snapshot"] = f"SELECT request_id, fetch_error, md5(data) AS data_md5 FROM {SNAPSHOT}"
SQL["dispatch_fetch"] = f"""SELECT request_id, CASE WHEN name IN ('data', 'http') THEN name END AS driver,
  CAST(coalesce(rule, CASE WHEN fetch_error IS NOT NULL THEN 9 END) AS BIGINT) AS rule,
  coalesce(message, fetch_error) AS error, md5(data) AS data_md5 FROM {FETCHED}"""

PATHS = """(SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '/app' WHEN 1 THEN '/app/' || lower(lang)
    WHEN 2 THEN '/app/x/../' || lower(lang) WHEN 3 THEN '/app2' WHEN 4 THEN '/app/../' || lower(lang)
    WHEN 5 THEN '/app/./' || lower(lang) || '//b' WHEN 6 THEN '/etc/app/' || lower(lang)
    ELSE '/app/x/../../app/' || lower(lang) END AS path FROM documents)"""
SQL["safe_path_prefix"] = f"SELECT doc_id, path, {safe('path', 'prefix')} AS safe FROM {PATHS}"
SQL["safe_path_strict"] = f"""SELECT doc_id, path, {normalize_path('path')} AS normalized,
  {safe('path', 'strict')} AS safe FROM {PATHS}"""
SQL["gate_options"] = f"""SELECT request_id, json_extract_string(conv, '$.filter') AS filter_in,
  json_extract_string(conv, '$.filter') AS filter_kept, CAST(NULL AS VARCHAR) AS lua_filter_kept
  FROM {PARSED} WHERE conv IS NOT NULL"""


def _option_arm(ord_: int, key: str, typ: str) -> str | None:
    flag = flag_name(key)
    v = f"json_extract_string(conv, '$.{key}')"
    base = f"FROM {PARSED} WHERE conv IS NOT NULL"
    head = f"SELECT request_id, CAST({ord_} AS INTEGER) AS ord"
    if key in ("filter", "lua_filter"):  # gated off in the default job config
        return None
    if typ == "b":
        return f"{head}, CAST(1 AS INTEGER) AS sub, '{flag}' AS flag, CAST(NULL AS VARCHAR) AS value {base} AND {v} = 'true'"
    if typ == "i":
        iv = f"CAST({v} AS BIGINT)"
        return (f"{head}, CAST(1 AS INTEGER) AS sub, '{flag}' AS flag, CAST({iv} AS VARCHAR) AS value {base} "
                f"AND coalesce({iv}, 0) <> 0")
    if typ in ("s", "f"):
        if key == "pdf_engine":
            return (f"{head}, CAST(1 AS INTEGER) AS sub, '{flag}' AS flag, CASE WHEN coalesce({v}, '') = '' "
                    f"THEN 'xelatex' ELSE {v} END AS value {base}")
        extra = f" AND upper({v}) <> 'PDF'" if key == "to" else ""
        return f"{head}, CAST(1 AS INTEGER) AS sub, '{flag}' AS flag, {v} AS value {base} AND coalesce({v}, '') <> ''{extra}"
    keys = f"(SELECT request_id, m, unnest(json_keys(m)) AS k FROM (SELECT request_id, json_extract(conv, '$.{key}') AS m {base}))"
    if typ == "m":
        return (f"{head}, CAST(row_number() OVER (PARTITION BY request_id ORDER BY k) AS INTEGER) AS sub, "
                f"'{flag}' AS flag, k || '=' || json_extract_string(m, '$.\"' || k || '\"') AS value FROM {keys}")
    vals = (f"(SELECT request_id, k, unnest(vs) AS v, generate_subscripts(vs, 1) AS vi FROM "
            f"(SELECT request_id, k, CAST(json_extract(m, '$.\"' || k || '\"') AS VARCHAR[]) AS vs FROM {keys}))")
    return (f"{head}, CAST(row_number() OVER (PARTITION BY request_id ORDER BY k, vi) AS INTEGER) AS sub, "
            f"'{flag}' AS flag, k || '=' || v AS value FROM {vals}")


def options_long_sql(only: tuple[str, ...] | None = None) -> str:
    arms = [_option_arm(o, k, t) for o, (k, t) in enumerate(OPTION_FIELDS, start=1) if only is None or k in only]
    return "(" + "\nUNION ALL ".join(a for a in arms if a) + ")"


SQL["options_long"] = f"SELECT * FROM {options_long_sql()}"
SQL["option_usage"] = f"""SELECT flag, count(*) AS n_rows, count(DISTINCT request_id) AS n_requests
  FROM {options_long_sql()} GROUP BY flag"""
SQL["key_values"] = f"""SELECT request_id, replace(substr(flag, 3), '-', '_') AS field, sub AS pos, value AS kv
  FROM {options_long_sql(('variable', 'metadata', 'request_header'))}"""
SQL["replace_map"] = """SELECT page_id AS doc_id, md5(replace(replace(replace(replace(html, '<br>', ' '), 'example',
  'sample-' || CAST(page_id % 3 AS VARCHAR)), 'ht', 'HT'), 'http', 'https')) AS content_md5 FROM pages"""
_EXT = "CASE ct " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIME_EXT.items()) + " ELSE '' END"
SQL["resource_name"] = f"""SELECT doc_id, CASE WHEN instr(nm, '.') > 0 THEN nm ELSE nm || {_EXT} END AS name
  FROM (SELECT doc_id, ct, CASE WHEN base = '' THEN md5(url) ELSE base END AS nm
    FROM (SELECT page_id AS doc_id, url, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain'
            ELSE 'application/x-y' END AS ct,
            regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', 0) AS base
          FROM pages))"""
_URI = S.q(DATA_URI_RE)
SQL["decode_data_uris"] = f"""SELECT item_id, matched, CASE WHEN matched THEN regexp_extract(ref, {_URI}, 1) END
    AS content_type, CASE WHEN matched AND {S.b64_valid('pl')} THEN md5(from_base64(pl)) END AS data_md5,
  CASE WHEN NOT matched THEN 'not a data uri' WHEN NOT {S.b64_valid('pl')} THEN 'bad base64 payload' END AS error
  FROM (SELECT item_id, ref, regexp_matches(ref, {_URI}) AS matched, regexp_extract(ref, {_URI}, 3) AS pl
    FROM (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'data:text/plain,' ELSE 'data:text/plain;base64,' END
            || to_base64(encode(text)) AS ref FROM benchmark))"""
SQL["option_value_usage"] = f"""SELECT flag, coalesce(value, '') AS value, count(*) AS n_rows,
  count(DISTINCT request_id) AS n_requests FROM {options_long_sql()} GROUP BY 1, 2"""
SQL["export_json_maps"] = f"""SELECT {S.json_safe("to_json(struct_pack(event_id := event_id, props := m))")} AS json
  FROM (SELECT event_id, map_from_entries(list_sort(list_concat(
      list_transform(json_keys(props), lambda k: struct_pack(key := k, value := json_extract_string(props, '$.' || k))),
      [struct_pack(key := 'a_type', value := event_type)]))) AS m FROM events)"""
