"""The registered queries in DuckDB SQL, written apart from their Spark form."""

from __future__ import annotations

#: Words with their boxes, and lines of two words or more.
WORDS = """WITH l AS (SELECT file, corpus, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_ord
    FROM (SELECT doc_id AS file, lang AS corpus, string_split(text, chr(10)) AS ls FROM documents)),
  p AS (SELECT file, corpus, line_ord, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM l),
  w0 AS (SELECT file, corpus, line_ord, len(ws) AS n, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS k FROM p),
  w1 AS (SELECT *, list_sum(list_transform(string_split(text, ''), lambda c: 4 + unicode(c) % 13))::BIGINT AS width FROM w0),
  w AS (SELECT *, (100 + coalesce(sum(width + 6 + k % 3) OVER (PARTITION BY file, line_ord ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS hpos FROM w1),
  x AS (SELECT *, length(text) AS len, lead(hpos) OVER g AS next_hpos, lead(length(text)) OVER g AS next_len, lead(width) OVER g AS next_width, lead(text) OVER g AS next_text FROM w WHERE n >= 2 WINDOW g AS (PARTITION BY file, line_ord ORDER BY k)),
  lines AS (SELECT corpus, file, line_ord, count(*) AS n, sum(len)::BIGINT AS chars, max(hpos + width) - 100 AS width, string_agg(text, ' ' ORDER BY k) AS line FROM x GROUP BY ALL)
"""
#: Each blank of a whole-line case: the predicted middle from one division a boundary.
WHOLE = WORDS + """, run AS (SELECT x.*, lines.width AS box, lines.chars + lines.n - 1 AS nc, 10 * lines.chars + 6 * (lines.n - 1) AS total,
    (10 * sum(len) OVER (PARTITION BY x.file, x.line_ord ORDER BY k) + 6 * k)::DOUBLE AS upto FROM x JOIN lines USING (file, line_ord)),
  cut AS (SELECT *, 100 + round_even(box * upto / total, 0) AS a, 100 + round_even(box * (upto + 6) / total, 0) AS b FROM run),
  err AS (SELECT corpus, file, line_ord, k, box / nc AS unit, greatest(hpos + width - (a + (b - a) / 2), a + (b - a) / 2 - next_hpos, 0) AS e FROM cut WHERE next_hpos IS NOT NULL)
"""
PAIR = WORDS + """, pair AS (SELECT *, next_hpos + next_width - hpos AS box, 10 * (len + next_len) + 6 AS total FROM x WHERE next_hpos IS NOT NULL),
  cut2 AS (SELECT *, hpos + round_even(box * (10.0 * len) / total, 0) AS a, hpos + round_even(box * (10.0 * len + 6) / total, 0) AS b FROM pair),
  err2 AS (SELECT corpus, file, line_ord, k, box / (len + next_len + 1) AS unit, greatest(hpos + width - (a + (b - a) / 2), a + (b - a) / 2 - next_hpos, 0) AS e FROM cut2)
"""
#: The same with a running sum of weight times unit, added one after another.
UNIT = WORDS + """, run AS (SELECT corpus, file, line_ord, list(len ORDER BY k) AS lens, list(hpos ORDER BY k) AS hs, list(hpos + width ORDER BY k) AS rs, count(*) AS n FROM x GROUP BY ALL),
  unit AS (SELECT *, rs[n] - 100 AS box, list_sum(lens) + n - 1 AS nc, (rs[n] - 100) / ((10 * list_sum(lens) + 6 * (n - 1)) / 10.0) AS u FROM run),
  step AS (SELECT *, list_transform(range(1, 2 * n), lambda j: CASE WHEN j % 2 = 1 THEN lens[(j + 1) // 2] * 1.0::DOUBLE ELSE 0.6::DOUBLE END * u) AS ss FROM unit),
  cum AS (SELECT *, list_transform(range(1, 2 * n), lambda j: list_reduce(list_prepend(0.0::DOUBLE, ss[1:j]), lambda p, q: p + q)) AS cs FROM step),
  pos AS (SELECT corpus, file, line_ord, box / nc AS unit, unnest(range(1, n)) AS k, hs, rs, cs FROM cum),
  err AS (SELECT corpus, file, line_ord, k, unit, greatest(rs[k] - m, m - hs[k + 1], 0) AS e FROM (SELECT *, 100 + (round_even(cs[2 * k - 1], 0) + round_even(cs[2 * k], 0)) / 2 AS m FROM pos))
"""


def report(base: str, err: str, cases: str) -> str:
    return base + f"""SELECT c.corpus, c.cases, 0::BIGINT AS failures, count(*) AS boundaries, round(avg(e), 6) AS mean, round(median(e), 6) AS median, round(max(e)::DOUBLE, 6) AS worst,
      round(avg(e / unit), 6) AS mean_chars, round(avg(CASE WHEN e / unit <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS within_half_char,
      round((list_sort(list(e)))[1 + floor(0.9 * (count(*) - 1) + 0.5)::BIGINT]::DOUBLE, 6) AS p90
    FROM {err} JOIN (SELECT corpus, count(*) AS cases FROM {cases} GROUP BY 1) c USING (corpus) GROUP BY c.corpus, c.cases"""


#: Line boxes of the derived pages.
BOXES = """WITH l AS (SELECT doc_id AS file, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_ord FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  o AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_ord) - 1 AS ord, count(*) OVER (PARTITION BY file) AS total FROM l WHERE len(list_filter(string_split(line, ' '), lambda x: x <> '')) > 0),
  c AS (SELECT *, 1 + file % 3 AS columns, ceil(total / (1 + file % 3))::BIGINT AS per, file % 10 AS fault FROM o),
  d AS (SELECT *, ord // per AS col0, ord % per AS r FROM c),
  boxes AS (SELECT file, ord, 200 + 1300 * col0 AS hpos,
      100 + 40 * (CASE WHEN fault = 3 AND col0 = 0 THEN per - 1 - r WHEN fault = 4 AND r >= 4 THEN r + 6 * (r // 4) ELSE r END) AS vpos,
      CASE WHEN fault = 2 AND r % 8 = 0 THEN 2600 ELSE 1100 END AS width, CASE WHEN fault = 1 AND r % 8 = 0 THEN 90 ELSE 30 END AS height, 400 + 1300 * columns AS page_width FROM d)
"""
TRIAGE = BOXES + """, j AS (SELECT *, coalesce(hpos - lag(hpos) OVER (PARTITION BY file ORDER BY hpos, ord) > 0.06 * page_width, false)::INT AS jump FROM boxes),
  s AS (SELECT *, sum(jump) OVER (PARTITION BY file ORDER BY hpos, ord) AS session FROM j),
  g AS (SELECT file, session, count(*) AS n, min(hpos) AS start FROM s GROUP BY ALL),
  pop AS (SELECT * FROM g QUALIFY n >= 8 OR max(n) OVER (PARTITION BY file) < 8),
  st AS (SELECT *, start - lag(start) OVER (PARTITION BY file ORDER BY start) AS step FROM pop),
  sp AS (SELECT file, count(*) AS columns, floor(median(step)) AS spacing FROM st GROUP BY 1),
  ty AS (SELECT file, median(width) AS typical FROM s SEMI JOIN pop USING (file, session) GROUP BY 1),
  bl AS (SELECT file, max(hpos + width) - min(hpos) AS block, min(hpos) AS lft, median(height) AS mid, count(*) AS lines FROM boxes GROUP BY 1),
  cw AS (SELECT file, lft, mid, lines, CASE WHEN columns >= 2 AND typical <= 1.35 * spacing THEN spacing ELSE block END AS column_width FROM bl JOIN sp USING (file) JOIN ty USING (file)),
  q AS (SELECT b.*, lft, mid, lines, column_width, trunc((hpos + width / 2 - lft) / column_width) AS col FROM boxes b JOIN cw USING (file)),
  z AS (SELECT *, lag(col) OVER v AS pcol, lag(vpos) OVER v AS pv, lag(height) OVER v AS ph FROM q WINDOW v AS (PARTITION BY file ORDER BY ord)),
  y AS (SELECT *, CASE WHEN col = pcol AND vpos > pv THEN vpos - pv END AS pitch, coalesce((col = pcol AND vpos < pv - ph) OR col < pcol, false) AS back FROM z),
  u AS (SELECT file, median(pitch) AS usual FROM y GROUP BY 1),
  t AS (SELECT file, lines, column_width, avg((height > 2.2 * mid)::INT) AS fused, avg((width > 1.35 * column_width)::INT) AS wide, sum(back::INT) AS nb, count(pitch) AS np, count(*) FILTER (pitch > 3 * usual) AS nbig FROM y JOIN u USING (file) GROUP BY ALL),
  v AS (SELECT file, lines, CASE WHEN lines < 2 THEN 0 ELSE column_width END::BIGINT AS column_width, CASE WHEN lines < 2 THEN 0 ELSE fused END AS fused, CASE WHEN lines < 2 THEN 0 ELSE wide END AS wide,
      CASE WHEN lines > 1 THEN nb / (lines - 1) ELSE 0 END AS disorder, CASE WHEN lines >= 3 AND np > 0 THEN nbig / np ELSE 0 END AS gaps FROM t),
  f AS (SELECT *, array_to_string(list_filter([CASE WHEN lines < 2 THEN 'few lines' END, CASE WHEN fused > 0.05 THEN 'fused' END, CASE WHEN wide > 0.05 THEN 'wide' END, CASE WHEN disorder > 0.1 THEN 'disorder' END, CASE WHEN gaps > 0.1 THEN 'gaps' END], lambda r: r IS NOT NULL), ',') AS reasons FROM v)
  SELECT file, lines, column_width, round(fused, 6)::DOUBLE AS fused, round(wide, 6)::DOUBLE AS wide, round(disorder, 6)::DOUBLE AS disorder, round(gaps, 6)::DOUBLE AS gaps, reasons = '' AS accepted, reasons FROM f"""
RESEGMENT = BOXES + """, m AS (SELECT *, median(height) OVER (PARTITION BY file) AS mid FROM boxes),
  o2 AS (SELECT a.file, a.ord, max(CASE WHEN least(a.hpos + a.width, b.hpos + b.width) - greatest(a.hpos, b.hpos) > 0 AND least(a.hpos + a.width, b.hpos + b.width) - greatest(a.hpos, b.hpos) >= 0.5 * least(a.width, b.width)
      THEN greatest(0, (least(a.vpos + a.height, b.vpos + b.height) - greatest(a.vpos, b.vpos)) / greatest(1, a.height)) ELSE 0 END) AS ov FROM boxes a JOIN boxes b ON a.file = b.file AND a.ord <> b.ord GROUP BY ALL),
  r AS (SELECT m.file, m.ord, coalesce(ov, 0) AS ov, CASE WHEN ov > 0.35 THEN 'overlap' WHEN height > 2.2 * mid THEN 'height' END AS reason FROM m LEFT JOIN o2 USING (file, ord))
  SELECT file, ord, round(ov, 6)::DOUBLE AS overlap, reason FROM r WHERE reason IS NOT NULL"""
RECTANGLES = BOXES + """, a AS (SELECT file, ord AS id, hpos AS x0, vpos AS y0, hpos + width AS x1, vpos + height AS y1 FROM boxes),
  b AS (SELECT file, id, x0 + id % 5 * 6 AS x0, y0 + id % 5 * 6 AS y0, x1 + id % 5 * 6 AS x1, y1 + id % 5 * 6 AS y1 FROM a),
  i AS (SELECT a.file, a.id AS a_id, b.id AS b_id, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS both_areas
      FROM a JOIN b ON a.file = b.file AND a.x0 < b.x1 AND b.x0 < a.x1),
  iou AS (SELECT file, a_id, b_id, inter / greatest(both_areas - inter, 1) AS iou FROM i WHERE inter / greatest(both_areas - inter, 1) >= 0.2)
"""


#: A line's text as XML can hold it.
IN_XML = r"regexp_replace(line, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', chr(65533), 'g')"
READ = WORDS + f"SELECT file::VARCHAR AS file, 'l' || line_ord AS line_id, 100::BIGINT AS hpos, (40 * line_ord)::BIGINT AS vpos, width, 30::BIGINT AS height, n AS words, md5({IN_XML}) AS text FROM lines"
#: Every line with words, also those of one.
ALL_LINES = WORDS + """, t AS (SELECT file, line_ord, count(*) AS n, max(hpos + width) - 100 AS width, string_agg(text, ' ' ORDER BY k) AS line FROM w GROUP BY ALL),
  a AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_ord) - 1 AS ord FROM t)
"""


#: The letters beyond ASCII in the tables' texts.  DuckDB's levenshtein compares bytes, so each becomes one byte that no text has.
BEYOND = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_FREE = " || ".join(f"chr({k})" for k in range(11, 11 + len(BEYOND)))


def levenshtein(a: str, b: str) -> str:
    """Edits between two texts in code points."""
    return "levenshtein({}, {})".format(*(f"translate({x}, '{BEYOND}', {_FREE})" for x in (a, b)))


#: Three neighbouring words: where the first blank is put, by one division or by a running sum of units.
FALLBACK = WORDS + """, t AS (SELECT corpus, file, hpos, len AS a, lead(len, 1) OVER g AS b, lead(len, 2) OVER g AS c, lead(hpos + width, 2) OVER g - hpos AS box FROM x WINDOW g AS (PARTITION BY file, line_ord ORDER BY k)),
  s AS (SELECT *, 10 * (a + b + c) + 12 AS total FROM t WHERE box IS NOT NULL)
  SELECT corpus, count(*) AS answered, sum(hpos + CASE WHEN file % 3 <> 0 THEN round_even(box * (10.0 * a) / total, 0) ELSE round_even(a * (box / (total / 10.0)), 0) END)::BIGINT AS hpos FROM s GROUP BY 1"""
#: Letters with the distance to the next one, against the line's median.
ADVANCES = WORDS + """, g AS (SELECT file, line_ord, unnest(string_split(text, '')) AS c FROM x), d AS (SELECT file, line_ord, c, 4 + unicode(c) % 13 AS step FROM g UNION ALL SELECT file, line_ord, ' ', 6 + k % 3 FROM x WHERE next_hpos IS NOT NULL),
  r AS (SELECT strip_accents(lower(c)) AS glyph, step / median(step) OVER (PARTITION BY file, line_ord) AS advance FROM d)
  SELECT glyph, round(median(advance), 6) AS advance, count(*) AS n FROM r GROUP BY 1"""
#: Pairs of turns by role, error band and kind of change.
SETS = rf"""WITH t AS (SELECT role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations),
  w AS (SELECT *, {levenshtein('text', 'other')} AS edits, length(other) AS size, len(regexp_extract_all(text, '\S+')) AS before, len(regexp_extract_all(other, '\S+')) AS after FROM t WHERE other IS NOT NULL),
  p AS (SELECT role, edits, size, CASE WHEN before < after THEN 'added' WHEN before > after THEN 'removed' ELSE 'same' END AS kind,
    CASE WHEN edits / greatest(1, size) <= 0.05 THEN '0-5' WHEN edits / greatest(1, size) <= 0.15 THEN '5-15' WHEN edits / greatest(1, size) <= 0.3 THEN '15-30' ELSE '>30' END AS band FROM w)
  SELECT role, band, kind, grouping_id(role, band, kind)::BIGINT AS level, count(*) AS pairs, sum(edits)::BIGINT AS edits, sum(size)::BIGINT AS size, round(sum(edits) / greatest(sum(size), 1), 6) AS cer, count_if(edits = 0)::BIGINT AS equal
  FROM p GROUP BY GROUPING SETS ((role, band), (role, kind), (role), ())"""


def oracle_sql() -> dict[str, str]:
    return {
        "space_tokens": r"""WITH t AS (SELECT lang, unnest(regexp_extract_all(translate(text, ',.', chr(160) || chr(8239)), '[^A-Za-zÀ-ÿ]+')) AS token FROM documents)
          SELECT lang, count(*) AS tokens, count_if(regexp_full_match(token, '[ \n\t\r\f\v]+'))::BIGINT AS spaces, count_if(regexp_full_match(token, '[ \n\t\r\f\v][ \n\t\r\f\v]+'))::BIGINT AS long_spaces FROM t GROUP BY 1""",
        "fallback_chain": FALLBACK,
        "advances": ADVANCES,
        "cer_by_sets": SETS,
        "proportional_report": report(UNIT, "err", "lines"),
        "merge_report": report(PAIR, "err2", "pair"),
        "decision": PAIR + WHOLE.removeprefix(WORDS) + """, b AS (SELECT corpus, max(e) AS worst, 1 - avg((e / unit <= 0.5)::INT) AS beyond FROM err GROUP BY 1),
          c AS (SELECT corpus, max(e) AS worst, 1 - avg((e / unit <= 0.5)::INT) AS beyond FROM err2 GROUP BY 1),
          d AS (SELECT c.beyond <= b.beyond / 2 + 1e-9 AS halved, c.worst <= b.worst + 1e-9 AS fine FROM b JOIN c USING (corpus))
          SELECT CASE WHEN count(*) < 3 THEN 'INCOMPLETE' WHEN bool_or(NOT fine) THEN 'REFUTED' WHEN count(*) FILTER (halved) >= 2 THEN 'CONFIRMED' ELSE 'REFUTED' END AS outcome, count(*) AS corpora, count(*) FILTER (halved) AS halved, count(*) FILTER (NOT fine) AS worse FROM d""",
        "case_counts": WORDS + """, r2 AS (SELECT corpus, 2 AS run, next_hpos + next_width - hpos AS bw, len + next_len + 1 AS nc FROM x WHERE next_hpos IS NOT NULL),
          y AS (SELECT *, lead(hpos + width, 2) OVER g AS r3, lead(len, 2) OVER g AS l3 FROM x WINDOW g AS (PARTITION BY file, line_ord ORDER BY k)),
          r3 AS (SELECT corpus, 3 AS run, r3 - hpos AS bw, len + next_len + l3 + 2 AS nc FROM y WHERE r3 IS NOT NULL),
          r0 AS (SELECT corpus, 0 AS run, width AS bw, chars + n - 1 AS nc FROM lines)
          SELECT corpus, run, count(*) AS cases, sum(bw)::BIGINT AS box_width, sum(nc)::BIGINT AS n_chars FROM (SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r0) GROUP BY ALL""",
        "line_scan": WORDS + "SELECT corpus, count(*) AS lines, sum(n)::BIGINT AS words, sum(width)::BIGINT AS width, 100::BIGINT AS hpos, sum(chars)::BIGINT AS chars FROM lines GROUP BY 1",
        "page_triage": TRIAGE,
        "resegment": RESEGMENT,
        "mojibake_repair": "SELECT doc_id, md5(text) AS fixed FROM documents WHERE length(text) > 0",
        "interleave": WORDS + "SELECT corpus, file, line_ord, 2 * n - 1 AS tokens, md5(line) AS line FROM lines",
        "char_widths": WORDS + "SELECT corpus, file, line_ord, round(width / (chars + n - 1), 6) AS unit FROM lines",
        "glue_and_drop": WORDS + """SELECT corpus, count(*)::BIGINT - count(*) FILTER (k = 0) AS glued_words, (sum(next_hpos + next_width - hpos) FILTER (k = 0))::BIGINT AS glued_width,
          count(*) FILTER (k <> 1) AS left_words, (sum(width) FILTER (k <> 1))::BIGINT AS left_width FROM x GROUP BY 1""",
        "stride_sample": WORDS + "SELECT file, count(*) AS sampled, sum(width)::BIGINT AS width FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_ord) - 1 AS r FROM lines) WHERE r % 4 = 0 GROUP BY 1",
        "word_edges": WHOLE + "SELECT corpus, count(*) AS edges, round(avg(abs(b - next_hpos)), 6) AS mean, max(abs(b - next_hpos))::BIGINT AS worst, 0::BIGINT AS tiling FROM cut WHERE next_hpos IS NOT NULL GROUP BY 1",
        "moved_boxes": UNIT.replace("  err AS", "  erru AS") + WHOLE.removeprefix(WORDS).replace(", run AS", ", runw AS").replace("FROM run)", "FROM runw)") + "SELECT (count(*) FILTER (abs(erru.e - err.e) > 1e-9))::BIGINT AS moved, count(*)::BIGINT AS boundaries FROM erru JOIN err ON erru.file = err.file AND erru.line_ord = err.line_ord AND erru.k = err.k + 1",
        "longest_long_words": WORDS + """, g AS (SELECT corpus, file, line_ord, k, k - row_number() OVER (PARTITION BY file, line_ord ORDER BY k) AS island FROM x WHERE len > 5),
          r AS (SELECT corpus, file, line_ord, island, count(*) AS c FROM g GROUP BY ALL), m AS (SELECT corpus, file, line_ord, max(c) AS run FROM r GROUP BY ALL)
          SELECT lines.corpus, max(coalesce(run, 0)) AS longest, sum(coalesce(run, 0))::BIGINT AS total FROM lines LEFT JOIN m USING (corpus, file, line_ord) GROUP BY 1""",
        "widest_lines": WORDS + "SELECT corpus, file, line_ord, width, rank FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY width DESC, file, line_ord) AS rank FROM lines) WHERE rank <= 6",
        "vocabulary_sets": WORDS + """, a AS (SELECT DISTINCT text FROM w WHERE corpus = 'en'), b AS (SELECT DISTINCT text FROM w WHERE corpus = 'fr')
          SELECT 'union' AS operation, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
        "last_correction": "SELECT source, lang, arg_max(n_chars, doc_id) AS last, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2",
        "nearest_turn": """WITH t AS (SELECT conv_id AS "group", turn AS id, role, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 2)) AS w FROM conversations),
          p AS (SELECT a."group", a.id AS target, b.id AS source, len(list_intersect(a.w, b.w)) AS common, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS both_sets FROM t a JOIN t b ON a."group" = b."group" AND a.role = 'assistant' AND b.role = 'user')
          SELECT "group", target, source, round(common / both_sets, 6) AS score FROM p WHERE common > 0 QUALIFY row_number() OVER (PARTITION BY "group", target ORDER BY common / both_sets DESC, source) = 1""",
        "order_inversions": BOXES + """, k AS (SELECT file, ord, row_number() OVER (PARTITION BY file ORDER BY vpos // 45, hpos, ord) AS rank FROM boxes)
          SELECT b.file, (SELECT count(*) FROM k p JOIN k q ON p.file = q.file AND p.ord < q.ord AND p.rank > q.rank WHERE p.file = b.file) AS inversions FROM (SELECT DISTINCT file FROM boxes) b""",
        "overlap_pairs": RECTANGLES + "SELECT file, a_id, b_id, round(iou, 6) AS iou FROM iou",
        "one_to_one_pairs": RECTANGLES + "SELECT file, a_id, b_id FROM iou QUALIFY count(*) OVER (PARTITION BY file, a_id) = 1 AND count(*) OVER (PARTITION BY file, b_id) = 1",
        "words_in_lines": WORDS + "SELECT file, line_ord AS line, md5(line) AS text FROM lines",
        "labelled": """SELECT lang, count(*) AS docs, 'left_semi' AS kind FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1
          UNION ALL SELECT lang, count(*), 'left_anti' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1""",
        "polygon_boxes": BOXES + "SELECT file, sum(hpos)::BIGINT AS hpos, sum(vpos)::BIGINT AS vpos, sum(width)::BIGINT AS width, sum(height)::BIGINT AS height FROM boxes GROUP BY 1",
        "quality_auc": """WITH d AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id)),
          r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS rk FROM d)
          SELECT lang, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS negative,
            round((sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / greatest(count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0), 1), 6) AS auc FROM r GROUP BY 1""",
        "event_counts": "SELECT event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1",
        "mojibake_repair_any": "SELECT doc_id, md5(text) AS fixed FROM documents",
        "independent_truth": WHOLE + """SELECT corpus, count(*) AS n, round(avg(CASE WHEN e / unit <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS within, round(avg(e / unit), 6) AS mean,
          round((list_sort(list(e / unit)))[1 + floor(0.9 * (count(*) - 1))::BIGINT], 6) AS p90 FROM err WHERE file % 7 <> 0 GROUP BY 1""",
        "insertion_edges": WHOLE + """, m AS (SELECT corpus, n, k, a, hpos, width, lag(b) OVER g AS l, sum(width) OVER (PARTITION BY file, line_ord) / sum(len) OVER (PARTITION BY file, line_ord) AS u
            FROM cut WHERE file % 7 <> 0 WINDOW g AS (PARTITION BY file, line_ord ORDER BY k)),
          v AS (SELECT corpus, abs(l - hpos) / u AS p, abs(a - (hpos + width)) / u AS q FROM m WHERE n >= 3 AND k = n // 2)
          SELECT corpus, count(*) AS n, round(avg(CASE WHEN p <= 0.5 AND q <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS both,
            round((list_sort(list(p)))[1 + least(count(*) - 1, floor(0.5 * count(*))::BIGINT)], 6) AS left_median, round((list_sort(list(p)))[1 + least(count(*) - 1, floor(0.9 * count(*))::BIGINT)], 6) AS left_p90,
            round((list_sort(list(q)))[1 + least(count(*) - 1, floor(0.5 * count(*))::BIGINT)], 6) AS right_median, round((list_sort(list(q)))[1 + least(count(*) - 1, floor(0.9 * count(*))::BIGINT)], 6) AS right_p90 FROM v GROUP BY 1""",
        "attached_truth": RECTANGLES + """, h AS (SELECT iou.file, a_id AS id, string_agg('line ' || b_id, ' ' ORDER BY y0, x0, b_id) AS truth, count(*) AS n FROM iou JOIN b ON b.file = iou.file AND b.id = b_id WHERE b_id % 6 <> 0 GROUP BY ALL)
          SELECT file, id, truth, CASE WHEN n >= 2 THEN 'fusion' WHEN n = 1 THEN '1:1' ELSE 'none' END AS kind FROM a LEFT JOIN h USING (file, id)""",
        "judgeable_lines": """SELECT s.conv_id, s.turn::BIGINT AS turn, length(s.text)::INT AS source, md5(CASE WHEN s.turn % 3 = 0 THEN '> ' || s.text ELSE s.text END) AS returned, md5(t.text) AS truth
          FROM conversations s JOIN conversations t ON s.conv_id = t.conv_id AND t.turn = s.turn + 1 WHERE trim(s.text) <> '' AND trim(t.text) <> ''""",
        "scaled_boxes": BOXES + """, c2 AS (SELECT *, CASE WHEN file % 4 <> 0 THEN 1 + 0.0125::DOUBLE * (file % 4) END AS sc FROM boxes)
          SELECT file, CASE WHEN file % 5 <> 0 THEN CASE WHEN abs(1.0125::DOUBLE - coalesce(sc, 1)) <= 0.02 THEN 'ok' ELSE 'off' END WHEN sc IS NOT NULL THEN 'stated' ELSE 'unknown' END AS state,
            sum(greatest(0, least(page_width - 1, round_even((hpos + width) * coalesce(sc, 1), 0))))::BIGINT AS edges FROM c2 GROUP BY ALL""",
        "alto_lines": READ,
        "page_lines": READ,
        "djvu_lines": WORDS + f"SELECT file::VARCHAR AS file, 'p1-l' || row_number() OVER (PARTITION BY file ORDER BY line_ord) AS line_id, 100::BIGINT AS hpos, 0::BIGINT AS vpos, width, 0::BIGINT AS height, n AS words, md5({IN_XML}) AS text FROM lines",
        "xml_boxes": ALL_LINES + f"""SELECT kind, file::VARCHAR AS file, ord, 'l' || line_ord AS line_id, 100::BIGINT AS hpos, (40 * line_ord)::BIGINT AS vpos, width, 30::BIGINT AS height, md5({IN_XML}) AS text,
            CASE WHEN kind = 'alto' THEN 3000 ELSE 0 END::BIGINT AS page_width FROM a, (VALUES ('alto'), ('page')) kinds(kind)""",
        "xml_texts": ALL_LINES + f"SELECT file::VARCHAR AS file, ord AS line_ord, 'l' || line_ord AS line_id, md5({IN_XML}) AS text, n % 2 = 0 AS has_hyphen FROM a",
    }
