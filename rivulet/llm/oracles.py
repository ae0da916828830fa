"""The queries of this subpackage as DuckDB SQL, where SQL can express them."""

from rivulet.llm.urls import HOST_RULES, PATTERNS

WORDS = r"string_split(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
    r"'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')), ' ')"

NEAR_DEDUP = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter({WORDS.format("coalesce(text, '')")}, lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM worded
), sized AS (
  SELECT doc_id, (SELECT count(*) FROM shingles AS s WHERE s.doc_id = d.doc_id) AS n FROM documents AS d
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n
  FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), linked AS (
  SELECT u, v FROM shared JOIN sized AS a ON a.doc_id = u JOIN sized AS b ON b.doc_id = v
  WHERE 100 * shared.n >= 80 * (a.n + b.n - shared.n)
), ways AS (SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, ways.v FROM reach JOIN ways ON ways.u = reach.other
)
SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach JOIN sized USING (doc_id) GROUP BY doc_id
"""

LINE_DEDUP = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM cut
), marked AS (
  SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _regex(pattern: str) -> str:
    body = pattern.strip("|")
    for c in "\\.+?$()[]{}":
        body = body.replace(c, "\\" + c)
    body = body.replace("*", ".*").replace("^", "(?:[^a-z0-9_.%-]|$)")
    front = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if pattern.startswith("||") else ""
    return front + body


_LOW = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MATCHES = {
    kind: " OR ".join(f"regexp_matches({_LOW}, '{_regex(p)}')" for k, p in PATTERNS if k == kind)
    for kind in ("allow", "block")
}
URL_VERDICTS = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in HOST_RULES)}),
parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path,
    row_number() OVER () AS row
  FROM pages
), fits AS (
  SELECT row, rules.host || rules.path AS rule, verdict FROM parts JOIN rules
  ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(parts.path, rules.path)
), best AS (
  SELECT row, rule, verdict FROM fits
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule) DESC, verdict DESC) = 1
)
SELECT page_id, host, path, rule,
  CASE WHEN verdict IS NOT NULL THEN verdict
       WHEN url IS NULL OR ({_MATCHES["allow"]}) THEN 'allow'
       WHEN {_MATCHES["block"]} THEN 'block' ELSE 'allow' END AS verdict
FROM parts LEFT JOIN best USING (row)
"""

# CRC-32 of a list of bytes, bit by bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, {0}), lambda s, b: list_reduce(" \
    "list_prepend(xor(s, b), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
BYTES = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] " \
    "ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))"

SPELLING_VARIANTS = rf"""
WITH RECURSIVE found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+'
  )) AS run FROM documents
), marked AS (
  SELECT run, count(*) AS n, {CRC32.format(BYTES.format("id || ':' || run"))} AS h
  FROM found WHERE length(run) >= 5 GROUP BY id, run
), changed AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM marked
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (SELECT word, n, unnest(range(length(word))) AS k FROM words
), holes AS (SELECT word, n, left(word, k) || '*' || substr(word, k + 2) AS hole, left(word, k) || substr(word, k + 2) AS rest FROM places
), near AS (
  SELECT a.word AS word, b.word AS other, b.n FROM holes AS a JOIN holes AS b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes AS a JOIN words AS b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes AS a JOIN words AS b ON a.rest = b.word
), best AS (
  SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1
), told AS (
  SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * words.n THEN other END AS form,
         CASE WHEN best.n >= 2 * words.n THEN best.n END AS form_n
  FROM words LEFT JOIN best USING (word)
), ways AS (
  SELECT word, word AS root FROM told
  UNION ALL SELECT ways.word, told.form FROM ways JOIN told ON told.word = ways.root WHERE told.form IS NOT NULL
), ends AS (SELECT ways.word, root FROM ways JOIN told ON told.word = root WHERE told.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)
"""

PERIODIC_RUNS = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, {CRC32.format(BYTES.format("doc_id::VARCHAR"))} AS h,
         list_filter(string_split(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents
), placed AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM texts
), planted AS (
  SELECT row, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
    CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w
  FROM placed
), six AS (
  SELECT row, n, unnest(range(n - 5)) AS i, unnest(list_transform(range(n - 5), lambda i: array_to_string(w[i + 1 : i + 6], ' '))) AS s
  FROM planted WHERE n >= 6
), agree AS (
  SELECT x.row, y.i - x.i AS q, x.i FROM six AS x JOIN six AS y
  ON x.row = y.row AND x.s = y.s AND x.i < y.i AND 2 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT row, q, min(i) AS start, count(*) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM agree) GROUP BY row, q, island
), runs AS (
  SELECT row, start, length, min(q) AS period FROM stretches WHERE length >= 12 AND length >= 2 * q GROUP BY ALL
), told AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY row
), longest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY row ORDER BY length DESC, start, period) = 1
), gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT row, unnest(range(n)) AS i, unnest(w) AS word FROM planted) ANTI JOIN gone USING (row, i) GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM planted LEFT JOIN told USING (row) LEFT JOIN longest USING (row) LEFT JOIN kept USING (row)
"""

ORACLES: dict[str, str] = {
    "op1_minmax_near_dedup": NEAR_DEDUP,
    "op5_line_dedup": LINE_DEDUP,
    "op7_url_verdicts": URL_VERDICTS,
    "op12_spelling_variants": SPELLING_VARIANTS,
    "op13_periodic_runs": PERIODIC_RUNS,
}
