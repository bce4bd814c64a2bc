"""DuckDB SQL of the queries over ink, written apart from their Spark form."""

from __future__ import annotations

IMAGES = """WITH v AS (SELECT vec_id // 16 AS image, vec_id % 16 AS y, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings),
  p AS (SELECT image, y, x, least(greatest(floor((v + 0.3::DOUBLE) * 425.0::DOUBLE)::BIGINT + CASE WHEN x // 8 % 4 = 3 THEN 200 ELSE 0 END, 0), 255) AS grey FROM v),
  h AS (SELECT image, grey AS level, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2),
  c AS (SELECT image, level, sum(n) OVER u AS dark, sum(level * n) OVER u AS s, sum(n) OVER (PARTITION BY image) AS a, sum(level * n) OVER (PARTITION BY image) AS t FROM h WINDOW u AS (PARTITION BY image ORDER BY level)),
  w AS (SELECT image, level, dark / a AS share, s / a AS mean, t / a AS whole, CASE WHEN a > dark THEN dark * (a - dark) * ((s / dark - (t - s) / (a - dark)) * (s / dark - (t - s) / (a - dark))) END AS below FROM c),
  x AS (SELECT *, (whole * share - mean) * (whole * share - mean) / CASE WHEN share * (1 - share) = 0 THEN 1e-9 ELSE share * (1 - share) END AS at_v FROM w),
  levels AS (SELECT image, CASE WHEN max(at_v) > 0 THEN arg_max(level, (at_v, -level)) ELSE 0 END AS at_level, coalesce(arg_max(level, (below, -level)) FILTER (below IS NOT NULL), 128) AS below_level FROM x GROUP BY 1),
  cols AS (SELECT image, x, min(grey) AS darkest FROM p GROUP BY 1, 2)
"""
RUNS = IMAGES + """, rules AS (SELECT image, 'at' AS rule, at_level AS level FROM levels UNION ALL SELECT image, 'below', below_level FROM levels),
  b AS (SELECT image, rule, x, x - row_number() OVER (PARTITION BY image, rule ORDER BY x) AS run FROM cols JOIN rules USING (image) WHERE CASE rule WHEN 'at' THEN darkest > level ELSE darkest >= level END),
  hs AS (SELECT image, max(y) + 1 AS height FROM p GROUP BY 1),
  r AS (SELECT image, rule, min(x) AS a, max(x) + 1 AS e FROM b GROUP BY image, rule, run),
  k AS (SELECT image, rule, count(*) AS runs, sum(a)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM r JOIN hs USING (image) WHERE e - a >= greatest(2, height // 8) GROUP BY 1, 2)
  SELECT image, rule, level, coalesce(runs, 0) AS runs, coalesce(starts, 0) AS starts, coalesce(ends, 0) AS ends FROM rules LEFT JOIN k USING (image, rule)"""
CUTS = IMAGES + """, q AS (SELECT DISTINCT image, y AS k, (image * 7 + y * 11) % 70 - 3 AS a, (image * 5 + y * 23) % 66 AS b FROM p),
  i AS (SELECT image, x, darkest <= at_level AS inked FROM cols JOIN levels USING (image)),
  s AS (SELECT q.k % 4 AS part, CASE WHEN m.inked THEN 1 WHEN NOT m.inked THEN 0 END AS a, CASE WHEN o.inked THEN 1 WHEN NOT o.inked THEN 0 END AS b FROM q LEFT JOIN i m ON m.image = q.image AND m.x = q.a LEFT JOIN i o ON o.image = q.image AND o.x = q.b WHERE abs(q.a - q.b) >= 15)
  SELECT part, count(*) AS cuts, count_if(a = 0)::BIGINT AS a_blank, count_if(a IS NULL)::BIGINT AS a_outside, count_if(b = 0)::BIGINT AS b_blank, count_if(b IS NULL)::BIGINT AS b_outside,
    count_if(a = 0 AND b = 0)::BIGINT AS both_blank, count_if(a = 0 AND b = 1)::BIGINT AS only_a, count_if(a = 1 AND b = 0)::BIGINT AS only_b, count_if(a = 1 AND b = 1)::BIGINT AS neither FROM s GROUP BY 1"""
UNCOVERED = IMAGES + """, k AS (SELECT DISTINCT image FROM p),
  boxes AS (SELECT image, image % 9 AS x, 2 AS y, 40 + image % 7 AS w, 8 AS h FROM k UNION ALL SELECT image, 30 + image % 5, 6 + image % 3, 60, 12 FROM k UNION ALL SELECT image, 100, 20 + image % 8, 10 + image % 31, 10 FROM k),
  e AS (SELECT image, trunc((x - w * 0.1::DOUBLE) * 0.5::DOUBLE) AS x0, trunc((x + (w + w * 0.1::DOUBLE)) * 0.5::DOUBLE) AS x1, trunc((y - h * 0.1::DOUBLE) * 0.5::DOUBLE) AS y0, trunc((y + (h + h * 0.1::DOUBLE)) * 0.5::DOUBLE) AS y1 FROM boxes),
  i AS (SELECT image, x, y FROM p JOIN levels USING (image) WHERE grey < below_level),
  o AS (SELECT image, x, y FROM i ANTI JOIN e ON e.image = i.image AND i.x BETWEEN x0 AND x1 AND i.y BETWEEN y0 AND y1)
  SELECT image, coalesce(ink, 0) AS ink, coalesce(outside, 0) AS outside, round(coalesce(coalesce(outside, 0) / ink, 0)::DOUBLE, 6) AS uncovered FROM k LEFT JOIN (SELECT image, count(*) AS ink FROM i GROUP BY 1) USING (image) LEFT JOIN (SELECT image, count(*) AS outside FROM o GROUP BY 1) USING (image)"""


def oracle_sql() -> dict[str, str]:
    return {"ink_runs": RUNS, "ink_under_cuts": CUTS, "uncovered_ink": UNCOVERED}
