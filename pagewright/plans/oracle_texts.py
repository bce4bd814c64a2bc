"""DuckDB SQL of the queries over returned texts, written apart from their Spark form."""

from __future__ import annotations

from .oracle import levenshtein

#: Lines with some words broken at line ends.
HYPHENATED = """WITH l AS (SELECT doc_id AS page, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  w AS (SELECT page, ord, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM l),
  n AS (SELECT *, coalesce((page + ord) % 4 = 1 AND len(ws) >= 2 AND length(ws[-1]) >= 6 AND len(lead(ws) OVER p) > 0, false) AS cut, lag(ws) OVER p AS above FROM w WINDOW p AS (PARTITION BY page ORDER BY ord)),
  b AS (SELECT *, coalesce(lag(cut) OVER (PARTITION BY page ORDER BY ord), false) AS tail FROM n),
  h AS (SELECT page, ord, cut, array_to_string(list_concat(CASE WHEN tail THEN [above[-1][4:]] ELSE [] END, CASE WHEN cut THEN list_append(ws[1:len(ws) - 1], ws[-1][1:3] || CASE WHEN page % 2 = 0 THEN '-' ELSE '' END) ELSE ws END), ' ') AS text, len(ws) AS own FROM b)
"""
PUT_BACK_CONTROL = HYPHENATED + """SELECT page, count(*) AS lines, sum(length(text))::BIGINT AS chars, max(md5(text)) AS top, min(md5(text)) AS bottom, sum(own)::BIGINT AS words, count_if(cut)::BIGINT AS joined FROM h GROUP BY 1"""


#: Results of two producers.
RUNS = f"""WITH l AS (SELECT lang AS corpus, doc_id AS page, unnest(ls) AS truth, unnest(list_append(ls[2:], NULL)) AS following, generate_subscripts(ls, 1) - 1 AS ord FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  s AS (SELECT *, CASE WHEN (page + ord) % 3 = 0 THEN translate(truth, 'e', 'c') ELSE truth END AS source FROM l WHERE trim(truth) <> ''),
  r AS (SELECT corpus, page, ord, source, truth, producer, CASE WHEN (page + ord + turn) % 7 = 3 THEN coalesce(following, truth) WHEN (page + ord + turn) % 5 = 1 THEN reverse(truth[1:40]) || ' ' || truth WHEN (page + ord + turn) % 9 = 0 THEN source ELSE truth END AS output
    FROM s, (VALUES (0, 'first'), (2, 'second')) v(turn, producer)),
  e AS (SELECT *, {levenshtein('source', 'truth')} AS b4, {levenshtein('output', 'truth')} AS af FROM r)
"""
CORRECTIONS = RUNS + """, k AS (SELECT corpus, page, ord, output, count(DISTINCT producer) AS producers FROM r WHERE output <> source GROUP BY ALL),
  t AS (SELECT corpus, count(*) AS corrections, count_if(producers > 1)::BIGINT AS shared FROM k GROUP BY 1)
  SELECT corpus, producer, count_if(output <> source)::BIGINT AS changed, count_if(output <> source AND af < b4)::BIGINT AS better, count_if(output <> source AND af > b4)::BIGINT AS worse,
    round(sum(b4) / sum(length(truth)), 6) AS cer_before, round(sum(af) / sum(length(truth)), 6) AS cer_after, any_value(corrections) AS corrections, any_value(shared) AS shared FROM e JOIN t USING (corpus) GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    return {"put_back_control": PUT_BACK_CONTROL, "correction_counts": CORRECTIONS}
