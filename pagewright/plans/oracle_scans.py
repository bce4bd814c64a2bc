"""DuckDB SQL of the queries over scans, written apart from their Spark form."""

from __future__ import annotations

from .oracle import ALL_LINES, IN_XML, WORDS

BAND = ALL_LINES + """SELECT file::VARCHAR AS file, count(*) AS lines, min(40 * line_ord)::BIGINT AS top, max(40 * line_ord + 30)::BIGINT AS bottom, sum(width)::BIGINT AS width FROM a WHERE 40 * line_ord BETWEEN 80 AND 370 GROUP BY 1"""
LAST = ALL_LINES + f"""SELECT file::VARCHAR AS file, 'l' || (ord % 10) AS line_id, md5(arg_max({IN_XML}, ord)) AS text FROM a GROUP BY a.file, ord % 10"""
MATCHED = ALL_LINES + f"""SELECT kind, file::VARCHAR AS file, 'l' || line_ord AS line_id, 100::BIGINT AS x0, (40 * line_ord)::BIGINT AS y0, (100 + width)::BIGINT AS x1, (40 * line_ord + 30)::BIGINT AS y1, md5({IN_XML}) AS text FROM a, (VALUES ('alto'), ('page')) kinds(kind)"""
CACHES = WORDS + """SELECT file::VARCHAR AS file, count(DISTINCT line_ord) AS lines, sum(len + (k > 0)::INT)::BIGINT AS chars, sum(width + CASE WHEN next_hpos IS NULL THEN 0 ELSE next_hpos - hpos - width END)::BIGINT AS covered,
  count(next_hpos) AS blanks, sum(next_hpos - hpos - width)::BIGINT AS blank FROM x GROUP BY 1"""
SUMMARY = """SELECT lang AS corpus, source AS producer, count_if(doc_id % 3 = 0)::BIGINT AS changed, sum(n_chars)::BIGINT AS tokens_in, round(sum(n_chars) / 1000, 6) AS seconds, count_if(doc_id % 9 <> 4)::INT AS finished, count_if(doc_id % 9 = 4)::INT AS failed
  FROM documents GROUP BY 1, 2 HAVING min(doc_id) % 5 <> 3 AND min(doc_id) % 7 <> 5 AND min(doc_id) % 4 <> 2"""


CUTS = WORDS + """SELECT file::VARCHAR AS file, CASE WHEN line_ord % 7 = 3 THEN 'text and spans differ' END AS error, count(*) AS lines, sum(chars + n - 1)::BIGINT AS chars, sum(right_x)::BIGINT AS right_edge
  FROM (SELECT lines.*, 100 + width - CASE WHEN line_ord % 7 = 3 THEN 4 + unicode(line[-1]) % 13 ELSE 0 END AS right_x FROM lines) GROUP BY 1, 2"""
FOLDED = """SELECT doc_id, length(text) AS chars, md5(strip_accents(lower(text))) AS folded FROM documents WHERE text IS NOT NULL"""
TOKENS = r"""WITH t AS (SELECT lang, list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda w: length(w) >= 3) AS a, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) > 2) AS b FROM documents)
  SELECT lang, sum(len(a))::BIGINT AS words, sum(len(list_distinct(a)))::BIGINT AS different, sum(len(b))::BIGINT AS parts FROM t GROUP BY 1"""
ROTATING = WORDS + """, r AS (SELECT file, line_ord, n, row_number() OVER (PARTITION BY file ORDER BY line_ord) - 1 AS at_line, greatest(4, count(*) OVER (PARTITION BY file) // 20) AS step FROM lines),
  c AS (SELECT file, line_ord, at_line % (n - 1) AS place FROM r WHERE at_line % step = 0 AND at_line < 20 * step)
  SELECT file, count(*) AS lines, sum(place)::BIGINT AS places, sum(next_hpos + next_width - hpos)::BIGINT AS width, max(md5(text || next_text)) AS top FROM c JOIN x USING (file, line_ord) WHERE k = place GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "band_lines": BAND, "last_texts": LAST, "matched_scans": MATCHED, "cache_scans": CACHES, "campaign_summary": SUMMARY,
        "cut_scans": CUTS, "folded_texts": FOLDED, "word_tokens": TOKENS, "rotating_sample": ROTATING,
    }
