"""DuckDB SQL of the queries over readings, written apart from their Spark form."""

from __future__ import annotations

from .oracle import UNIT, WHOLE, WORDS

#: The figures of a report, from rows (corpus, status, e, unit) and (corpus, status, cases).
FIGURES = """count(*) AS boundaries, round(avg(e), 6) AS mean, round(median(e), 6) AS median, round(max(e)::DOUBLE, 6) AS worst,
    round(avg(e / unit), 6) AS mean_chars, round(avg(CASE WHEN e / unit <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS within_half_char,
    round((list_sort(list(e)))[1 + floor(0.9 * (count(*) - 1) + 0.5)::BIGINT]::DOUBLE, 6) AS p90"""
STATUS = "CASE WHEN (file + line_ord) % 11 = 0 THEN 'missing' WHEN (file + line_ord) % 13 = 5 THEN 'weak' ELSE 'read' END"
ENGINE = UNIT + f""", kind AS (SELECT corpus, file, line_ord, {STATUS} AS status, count(*) AS n, CASE WHEN (file + line_ord) % 5 = 0 AND min_by(width, k) >= 20 THEN 12 ELSE 0 END AS shift FROM x GROUP BY corpus, file, line_ord),
  e2 AS (SELECT err.corpus, status, unit, CASE WHEN status = 'read' AND shift = 12 THEN greatest(12 - (next_hpos - hpos - width) / 2, 0) WHEN status = 'read' THEN 0 ELSE e END AS e
    FROM err JOIN kind USING (file, line_ord) JOIN x ON x.file = err.file AND x.line_ord = err.line_ord AND x.k = err.k - 1)
  SELECT c.corpus, c.status, c.cases, 0::BIGINT AS failures, {FIGURES} FROM e2 JOIN (SELECT corpus, status, count(*) AS cases FROM kind GROUP BY 1, 2) c USING (corpus, status) GROUP BY c.corpus, c.status, c.cases"""
LAST_RESORT = WORDS + f""", kind AS (SELECT corpus, file, line_ord, {STATUS} AS status, min_by(hpos + width, k) AS blank FROM x GROUP BY corpus, file, line_ord)
  SELECT corpus, status, CASE status WHEN 'missing' THEN 'missing line' WHEN 'weak' THEN 'low support' END AS error, count(*) AS cases, count_if(status = 'read')::BIGINT AS answered, sum(CASE WHEN status = 'read' THEN blank END)::BIGINT AS first_blank FROM kind GROUP BY 1, 2, 3"""

#: What becomes of each file's pair, for a kind of cache that needs provenance or doesn't.
PAIRS = """, f AS (SELECT doc_id AS file, lang AS corpus FROM documents),
  m AS (SELECT *, CASE WHEN file % 16 = 9 THEN file - 1 ELSE file END AS cache FROM f WHERE file % 14 <> 3),
  u AS (SELECT cache, count(*) AS users FROM m GROUP BY 1),
  pairs AS (SELECT m.file, CASE WHEN file % 18 = 1 THEN 'repeated file' WHEN users > 1 THEN 'shared cache' WHEN cache % 20 = 11 OR cache NOT IN (SELECT file FROM f) THEN 'missing cache' WHEN cache % 10 = 7 THEN 'repeated cache'
    WHEN cache % 12 = 5 THEN '{lax}' WHEN cache % 9 = 4 OR cache <> file THEN 'layout differs' ELSE 'checked' END AS pair FROM m JOIN u USING (cache))
"""
PAIRED_CUTS = WORDS + PAIRS.format(lax="no provenance") + """SELECT corpus, coalesce(pair, 'no pair') AS pair, CASE WHEN pair IS DISTINCT FROM 'checked' THEN coalesce(pair, 'no pair') WHEN line_ord % 6 = 4 THEN 'missing line' END AS error,
    count(*) AS cases, count(DISTINCT file) AS files, sum(CASE WHEN pair = 'checked' AND line_ord % 6 <> 4 THEN n - 1 END)::BIGINT AS boundaries FROM lines LEFT JOIN pairs USING (file) GROUP BY 1, 2, 3"""
POOLED = WHOLE + f"""SELECT 'all' AS pool, (SELECT count(*) FROM lines) AS cases, 0::BIGINT AS failures, {FIGURES.replace("round(median(e), 6)", "round((list_sort(list(e)))[1 + count(*) // 2]::DOUBLE, 6)")} FROM err"""


def oracle_sql() -> dict[str, str]:
    return {"engine_words_report": ENGINE, "last_resort_report": LAST_RESORT, "paired_cuts": PAIRED_CUTS, "pooled_report": POOLED}
