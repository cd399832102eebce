"""Oracle SQL, step 4: outline operators."""

from __future__ import annotations

from quire.plans import sqlparts as S
from quire.plans.oracle import MD_DOCS, SQL

MD_BLOCKS = S.markdown_blocks(MD_DOCS)
CONV_BLOCKS = """(SELECT doc_id, b.block_no AS block_no, b.kind AS kind, b.level AS level, b.text AS text
  FROM (SELECT conv_id AS doc_id, unnest(CASE WHEN turn = 0 THEN [
      struct_pack(block_no := 1, kind := 'heading', level := 1, text := 'Conversation ' || CAST(conv_id AS VARCHAR)),
      struct_pack(block_no := CAST(turn * 2 + 2 AS INTEGER), kind := 'heading', level := 2, text := role),
      struct_pack(block_no := CAST(turn * 2 + 3 AS INTEGER), kind := 'para', level := 0, text := text)]
    ELSE [struct_pack(block_no := CAST(turn * 2 + 2 AS INTEGER), kind := 'heading', level := 2, text := role),
      struct_pack(block_no := CAST(turn * 2 + 3 AS INTEGER), kind := 'para', level := 0, text := text)] END) AS b
    FROM conversations))"""
RUN = "PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

SQL["shift_headings"] = f"""SELECT doc_id, block_no,
  CASE WHEN kind = 'heading' AND level + 5 > 6 THEN 'para' ELSE kind END AS kind,
  CAST(CASE WHEN kind = 'heading' AND level + 5 > 6 THEN 0 WHEN kind = 'heading' THEN level + 5 ELSE level END
    AS INTEGER) AS level FROM {MD_BLOCKS}"""

_cums = ", ".join(f"sum(CASE WHEN level = {k} THEN 1 ELSE 0 END) OVER ({RUN}) AS cum{k}" for k in range(1, 7))
_bases = ", ".join(
    f"coalesce(last_value(CASE WHEN level < {k} THEN cum{k} END IGNORE NULLS) OVER ({RUN}), 0) AS base{k}"
    for k in range(2, 7))
_parts = ", ".join(["CAST(cum1 + 1 AS VARCHAR)"] + [f"CAST(cum{k} - base{k} AS VARCHAR)" for k in range(2, 7)])
SQL["number_sections"] = f"""SELECT doc_id, block_no, level, text,
  array_to_string(list_slice([{_parts}], 1, level), '.') AS number
  FROM (SELECT *, {_bases} FROM (SELECT *, {_cums}
        FROM (SELECT doc_id, block_no, level, text FROM {MD_BLOCKS} WHERE kind = 'heading')))"""

_SLUG = """CASE WHEN s3 = '' THEN 'section' ELSE s3 END"""
SQL["header_ids"] = f"""SELECT doc_id, block_no,
  'c-' || CASE WHEN n = 0 THEN slug ELSE slug || '-' || CAST(n AS VARCHAR) END AS id
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY block_no) - 1 AS n
    FROM (SELECT *, {_SLUG} AS slug FROM (SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(lower(text),
            '[^a-z0-9_ -]', '', 'g')), ' +', '-', 'g'), '^[^a-z]+', '') AS s3
          FROM {CONV_BLOCKS} WHERE kind = 'heading')))"""
SQL["toc"] = f"""SELECT doc_id, count(*) AS n_entries,
  string_agg(repeat('  ', level - 1) || '- ' || text, chr(10) ORDER BY block_no) AS toc
  FROM {MD_BLOCKS} WHERE kind = 'heading' AND level <= 2 GROUP BY doc_id"""


def sections(blocks: str, level: int, unit: str) -> str:
    opens = f"(kind = 'heading' AND level <= {level})"
    return f"""SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, '{unit}' AS unit,
  max(CASE WHEN opens THEN text END) AS title, count(*) AS n_blocks,
  md5(coalesce(string_agg({S.plain_piece()}, {S.NL2} ORDER BY block_no) FILTER (WHERE NOT opens AND text <> ''), ''))
    AS text_md5
  FROM (SELECT *, {opens} AS opens, sum(CASE WHEN {opens} THEN 1 ELSE 0 END) OVER ({RUN}) AS section_no
        FROM {blocks}) GROUP BY doc_id, section_no"""


SQL["split_sections"] = sections(MD_BLOCKS, 2, "section")
SQL["split_chapters"] = sections(CONV_BLOCKS, 2, "chapter")
SQL["concat_documents"] = f"""SELECT conv_id, count(*) AS n_parts,
  md5(string_agg(text, {S.NL2} ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id"""

TURN_BLOCKS = """(SELECT conv_id * 100000 + turn AS doc_id, conv_id, turn, b.block_no AS block_no, b.kind AS kind,
    b.level AS level, b.text AS text
  FROM (SELECT conv_id, turn, unnest(list_concat([struct_pack(block_no := 1, kind := 'heading', level := 2,
      text := role)], list_transform(string_split(text, chr(10)), lambda x, i: struct_pack(
      block_no := CAST(i + 1 AS INTEGER), kind := 'para', level := 0, text := x)))) AS b FROM conversations))"""
COMBINED = f"""(SELECT conv_id AS doc_id, turn AS part, (CAST(turn AS BIGINT) << 32) + block_no AS block_no, kind,
    level, text FROM {TURN_BLOCKS})"""
SQL["concat_blocks"] = f"SELECT * FROM {COMBINED}"
SQL["concat_header_ids"] = f"""SELECT doc_id, block_no, CASE WHEN n = 0 THEN slug ELSE slug || '-' || CAST(n AS VARCHAR) END
    AS id
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY block_no) - 1 AS n
    FROM (SELECT *, {_SLUG} AS slug FROM (SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(lower(text),
            '[^a-z0-9_ -]', '', 'g')), ' +', '-', 'g'), '^[^a-z]+', '') AS s3
          FROM {COMBINED} WHERE kind = 'heading')))"""

_TURN_HEADS = """(SELECT conv_id, turn, 1 AS block_no, 2 AS level, role AS text FROM conversations
  UNION ALL SELECT conv_id, turn, 1000001 + i, 3, ls[i] FROM (
    SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)))"""
_TURN_SLUGS = f"""(SELECT *, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(
    lower(text), '[^a-z0-9_ -]', '', 'g')), ' +', '-', 'g'), '^[^a-z]+', '') AS s FROM {_TURN_HEADS}))"""
SQL["concat_file_scope"] = f"""SELECT conv_id AS doc_id, turn AS part, CAST(block_no AS BIGINT) AS block_no,
  slug || CASE WHEN n > 0 THEN '-' || n ELSE '' END AS id, CASE level WHEN 2 THEN '0.1' ELSE '0.1.' || (block_no - 1000001) END AS number
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, slug ORDER BY block_no) - 1 AS n FROM {_TURN_SLUGS})"""
