"""The queries of this subpackage in DuckDB SQL, written apart from their Spark form."""

from __future__ import annotations

#: Remainders of the 256 bytes under the polynomial of crc32.
CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS ct FROM range(256) r(b))"""


def crc32(text: str) -> str:
    """crc32 of a text of code points below U+0800, where ``ct`` is the list of :data:`CRC_TABLE`."""
    codes = f"list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)"
    raw = f"flatten(list_transform({codes}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {raw}), lambda x, b: xor(x >> 8, ct[(xor(x, b) & 255) + 1])), 4294967295)"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLINGS = f"""WITH RECURSIVE {CRC_TABLE},
  runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
  low AS (SELECT id, {LOWER.format("run")} AS run, count(*) AS n FROM runs GROUP BY ALL),
  hashed AS (SELECT run, n, {crc32("id || ':' || run")} AS h FROM low, crc_table),
  v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
  cut AS (SELECT DISTINCT word, word[1:i] || '_' || word[i + 2:] AS hole, word[1:i] || word[i + 2:] AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
  pairs AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b USING (hole) WHERE a.word <> b.word
    UNION SELECT cut.word, v.word FROM cut JOIN v ON v.word = less UNION SELECT v.word, cut.word FROM cut JOIN v ON v.word = less),
  best AS (SELECT p.word, count(*) AS n_near, max(o.n) AS form_n, arg_min(p.other, (-o.n, p.other)) AS form FROM pairs p JOIN v o ON o.word = p.other GROUP BY 1),
  formed AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
  chain AS (SELECT word, word AS root, form AS onward FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.onward)
  SELECT word, form, chain.root, n, n_near, form_n FROM formed JOIN chain USING (word) WHERE onward IS NULL"""

TRIE = f"""WITH {CRC_TABLE},
  t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  d AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS turn_id, length(text) AS chars FROM t),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_id) AS place FROM d),
  ids AS (SELECT conv_id, {crc32("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
  own AS (SELECT conv_id, place, turn_id, chars FROM placed JOIN ids USING (conv_id) WHERE place > h
    UNION ALL SELECT i.conv_id, p.place, p.turn_id, p.chars FROM ids i JOIN placed p ON p.conv_id = i.conv_id - i.conv_id % 100 WHERE p.place <= h),
  paths AS (SELECT conv_id, coalesce(list(turn_id ORDER BY place) FILTER (turn_id IS NOT NULL), []) AS path, coalesce(list(chars ORDER BY place) FILTER (turn_id IS NOT NULL), []) AS sizes FROM ids LEFT JOIN own USING (conv_id) GROUP BY 1),
  members AS (SELECT conv_id, path, sizes, unnest(range(len(path) + 1)) AS depth FROM paths),
  nodes AS (SELECT depth, path[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(sizes[depth]), 0) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256 FROM members GROUP BY 1, 2),
  kids AS (SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
  full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, node)),
  below AS (SELECT up AS depth, node[1:up] AS node, count_if(n_children = 0)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS up FROM full_nodes) GROUP BY 1, 2)
  SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
  FROM full_nodes f JOIN below USING (depth, node) LEFT JOIN full_nodes p ON p.depth = f.depth - 1 AND p.node = f.node[1:f.depth - 1]"""

LINES = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
  k AS (SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
  common AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT r) >= 3),
  m AS (SELECT r, doc_id, line, i, coalesce(owner IS DISTINCT FROM doc_id AND owner IS NOT NULL, false) AS gone FROM k LEFT JOIN common USING (key))
  SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r"""


#: Every word of every text, in order.
ALL_WORDS = r"""WITH d AS (SELECT doc_id, {text} AS text FROM documents),
  s AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
  w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM s)"""

WINDOWS = ALL_WORDS.format(text="coalesce(text, '')") + """,
  g AS (SELECT *, CASE WHEN i + 34 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS win FROM w),
  twice AS (SELECT win FROM g WHERE win IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
  m AS (SELECT doc_id, word, i, max((twice.win IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM g LEFT JOIN twice USING (win))
  SELECT s.doc_id, any_value(len(ws))::BIGINT AS n_words, count_if(gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM s LEFT JOIN m USING (doc_id) GROUP BY 1"""

NEAR = ALL_WORDS.format(text=LOWER.format("coalesce(text, '')")).replace("WITH d", "WITH RECURSIVE d", 1) + """,
  g AS (SELECT DISTINCT doc_id, hash(gram) AS gram FROM (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS gram FROM w) WHERE i + 2 <= n OR i = 1),
  size AS (SELECT d.doc_id, count(gram) AS n FROM d LEFT JOIN g USING (doc_id) GROUP BY 1),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
  edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
  reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
  SELECT size.doc_id, n AS n_shingles, component_id, size.doc_id = component_id AS kept FROM size JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""

BYTES = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
  p AS (SELECT doc_id, i, hex(h[i:i]) AS byte, CASE WHEN i + 99 <= octet_length(h) THEN hash(h[i:i + 99]) END AS win FROM (SELECT doc_id, h, unnest(range(1, octet_length(h) + 1)) AS i FROM d)),
  f AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM p),
  m AS (SELECT doc_id, i, byte, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
  e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM m)
  SELECT d.doc_id, any_value(octet_length(h))::BIGINT AS n_bytes, count_if(gone)::BIGINT AS n_removed, count_if(starts)::BIGINT AS n_spans, sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256 FROM d LEFT JOIN e USING (doc_id) GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": BYTES, "op6_bbit_minhash": NEAR, "op9_window_index": WINDOWS, "op11_spellings": SPELLINGS, "op12_prefix_trie": TRIE, "op13_line_index": LINES}
