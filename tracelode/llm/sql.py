"""SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_BLANK = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200D}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{2060}\\x{3000}\\x{FEFF}]"
_SPACE = "[\\s\\x{0B}\\x{0085}\\x{00A0}\\x{1680}\\x{180E}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def trimmed(column: str, blank: str = _SPACE) -> str:
    return f"regexp_replace({column}, '^{blank}|{blank}$', '', 'g')"


_RATINGS = """WITH u AS (SELECT DISTINCT task_id, lower(trim(model_used, ' ')) AS judge, raw_score AS s, timestamp FROM judge_audit_log
      WHERE trim(coalesce(error_flag, ''), ' ') = '' AND trim(coalesce(task_id, ''), ' ') <> '' AND coalesce(lower(trim(model_used, ' ')), '') <> '' AND raw_score IS NOT NULL AND NOT isnan(raw_score)),
    t AS (SELECT judge, max(s) AS top FROM u GROUP BY 1), r AS (SELECT task_id, judge, avg(least(1.0, greatest(0.0, CASE WHEN s > 1 THEN s / CASE WHEN top <= 10 THEN 10.0 ELSE 100.0 END ELSE s END))) AS s FROM u JOIN t USING (judge) GROUP BY 1, 2),
    n AS (SELECT task_id, count(*) FILTER (s < 0.35) AS a, count(*) FILTER (s >= 0.35 AND s < 0.7) AS b, count(*) FILTER (s >= 0.7) AS c, count(*) AS m FROM r GROUP BY 1 HAVING count(*) > 1)"""

P2_AGREEMENT = f"""{_RATINGS}, x AS (SELECT count(*) AS tasks, coalesce(CAST(sum(m) AS BIGINT), 0) AS n, sum((a * (m - a) + b * (m - b) + c * (m - c)) / (m - 1)) AS d, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc FROM n),
    o AS (SELECT tasks, n, d / n AS observed, (sa * (n - sa) + sb * (n - sb) + sc * (n - sc)) / (n * (n - 1)) AS expected FROM x)
    SELECT tasks, n AS ratings, round(observed, 9) AS observed, round(expected, 9) AS expected, round(1 - observed / expected, 9) AS alpha FROM o"""

P5_FOUND = f"""WITH RECURSIVE e AS (SELECT example_id AS id, coalesce({trimmed("lower(source)")}, '') AS source, nullif({trimmed("lower(session_id)")}, '') AS s,
      nullif(trim(regexp_replace(lower(task_input), '{_SPACE}', ' ', 'g'), ' '), '') AS t FROM eval_example),
    k AS (SELECT id, 's' || source || chr(1) || s AS key FROM e WHERE s IS NOT NULL UNION ALL SELECT id, 't' || t FROM e WHERE t IS NOT NULL),
    m AS (SELECT key, min(id) AS hub FROM k GROUP BY 1), l AS (SELECT DISTINCT id AS a, hub AS b FROM k JOIN m USING (key) WHERE id <> hub), g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    c(id, root) AS (SELECT a, a FROM g UNION SELECT g.b, c.root FROM c JOIN g ON g.a = c.id)
    SELECT id AS example_id, min(root) AS group_id FROM c GROUP BY 1"""


def p7_found(speakers: dict[str, str]) -> str:
    key = f"regexp_replace(lower({trimmed('role', _BLANK + '+')}), '[-\\s]+', '_', 'g')"
    cases = " ".join(f"WHEN r IN ({', '.join(repr(a) for a in names.split())}) THEN '{who}'" for who, names in speakers.items())
    said = f"length(regexp_replace(coalesce(content, ''), '{_BLANK}+', '', 'g')) > 0"
    return f"""WITH a AS (SELECT *, lower({trimmed("coalesce(session_id, '')", _BLANK + '+')}) AS k, {key} AS r FROM session_message),
      b AS (SELECT *, CASE WHEN r = 'session_meta' THEN 'session_meta' {cases} END AS who,
        coalesce(ordinal::BIGINT, epoch_us(try_cast(timestamp AS TIMESTAMPTZ))) AS place FROM a),
      d AS (SELECT k, place, ordinal, who, content, min(message_id) AS id, min(session_id) AS session_id, max(len(tool_calls)) AS calls FROM b GROUP BY k, place, ordinal, who, coalesce(who, r, ''), content),
      o AS (SELECT *, row_number() OVER w AS turn, sum(CASE WHEN who = 'user' THEN 1 ELSE 0 END) OVER w AS u FROM d WINDOW w AS (PARTITION BY k ORDER BY place, id)),
      s AS (SELECT k, u, bool_or(who = 'assistant' AND {said}) AS replied, bool_or(coalesce(who, '') = 'assistant') AS assistant, min(turn) FILTER (who = 'assistant' AND calls > 0) AS first_call, min(turn) FILTER (who = 'tool') AS first_tool FROM o GROUP BY 1, 2),
      f AS (SELECT k, bool_or(u = 0 AND assistant) AS early, bool_or(u > 0 AND NOT coalesce(replied, false)) AS silent, bool_or(first_tool IS NOT NULL AND (first_call IS NULL OR first_call > first_tool)) AS alone FROM s GROUP BY 1),
      g AS (SELECT k, min(session_id) AS session_id, bool_or(who IN ('user', 'assistant') AND {said}) AS said, bool_or(who IS NULL) AS nobody, count(ordinal) AS numbered, count(*) AS n, count(DISTINCT ordinal) AS distinct_ones, min(ordinal) AS lo, max(ordinal) AS hi FROM o GROUP BY 1),
      h AS (SELECT session_id, CASE WHEN NOT coalesce(said, false) THEN 'empty' WHEN nobody OR (numbered > 0 AND NOT (numbered = n AND distinct_ones = n AND lo = 0 AND hi = n - 1)) OR early OR alone THEN 'broken' WHEN silent THEN 'missing_reply' END AS defect FROM g JOIN f USING (k))
      SELECT session_id, defect FROM h WHERE defect IS NOT NULL"""


_WINDOWS = """WITH w AS (SELECT doc_id, i, hash(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
    m AS (SELECT h FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), s AS (SELECT w.* FROM w JOIN m USING (h))"""
P10_FOUND = f"{_WINDOWS}, d AS (SELECT DISTINCT h, doc_id FROM s) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.h = b.h AND a.doc_id < b.doc_id"
P10_SHARED = f"""{_WINDOWS}, g AS (SELECT doc_id, sum(least(300, i - coalesce(p, -300))) AS c FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT DISTINCT doc_id, i FROM s)) GROUP BY 1)
    SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars, CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE / length(text) END AS shared_fraction FROM documents LEFT JOIN g USING (doc_id)"""
P10_LENGTHS = """WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 300), z AS (SELECT max(n) AS n FROM t),
    l(w) AS (SELECT 300 UNION ALL SELECT 2 * w FROM l, z WHERE 2 * w <= n),
    x AS (SELECT doc_id, text, w, unnest(range(1, n - w + 2)) AS i FROM t JOIN l ON n >= w), h AS (SELECT doc_id, w, hash(substr(text, i, w)) AS h, hash(text) AS whole FROM x),
    m AS (SELECT w, h FROM h GROUP BY 1, 2 HAVING count(DISTINCT whole) > 1)
    SELECT doc_id, max(w)::INTEGER AS at_least FROM h JOIN m USING (w, h) GROUP BY 1"""

#: DuckDB has NFC but no NFKC: the compatibility forms that words are written in are the full-width ones and ligatures.
_WIDE, _PLAIN = ("".join(map(chr, range(first, first + 94))).replace("'", "''") for first in (0xFF01, 0x21))
_NORMAL = f"nfc_normalize(replace(replace(translate(coalesce(task_input, '') || ' ' || coalesce(expected_behavior, ''), '{_WIDE}', '{_PLAIN}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'))"
#: Brute force over shared shingles.
_SIMILAR = f"""WITH RECURSIVE w AS (SELECT example_id, regexp_extract_all(lower({_NORMAL}), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_example),
    s AS (SELECT DISTINCT example_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT example_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)), n AS (SELECT example_id, count(*) AS n FROM s GROUP BY 1),
    c AS (SELECT a.example_id AS a, b.example_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.example_id < b.example_id GROUP BY 1, 2),
    p AS (SELECT a, b, k / (x.n + y.n - k) AS similarity FROM c JOIN n x ON x.example_id = a JOIN n y ON y.example_id = b WHERE k >= 0.65 * (x.n + y.n - k) - 1e-9),
    t AS (SELECT example_id, lower(trim(split, ' ')) AS split, lower(trim(coalesce(source, ''), ' ')) AS source FROM eval_example),
    o AS (SELECT p.*, CASE WHEN x.split = 'train' THEN b ELSE a END AS held FROM p JOIN t x ON x.example_id = a JOIN t y ON y.example_id = b
      WHERE (x.split = 'train' AND y.split IN ('val', 'holdout')) OR (y.split = 'train' AND x.split IN ('val', 'holdout')))"""
P3_FOUND = f"{_SIMILAR} SELECT a AS example_id_a, b AS example_id_b FROM o"
P3_REPORT = f"""{_SIMILAR}, h AS (SELECT held AS example_id, max(similarity) AS most FROM o GROUP BY 1)
    SELECT split, source, count(*) AS records, count(most) AS overlapping, count(*) FILTER (most >= 1) AS exact FROM t LEFT JOIN h USING (example_id) WHERE split IN ('val', 'holdout') GROUP BY 1, 2"""
P4_FOUND = f"{_SIMILAR} SELECT a AS example_id_a, b AS example_id_b FROM p"
P4_CLASSES = f"""{_SIMILAR}, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(id, root) AS (SELECT example_id, example_id FROM eval_example UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
    f AS (SELECT id, min(root) AS class_id FROM r GROUP BY 1), d AS (SELECT a AS id, count(*) AS k FROM e GROUP BY 1)
    SELECT id AS example_id, class_id, coalesce(k, 0) AS n_links FROM f LEFT JOIN d USING (id)"""
