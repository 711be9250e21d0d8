"""DuckDB SQL for the rows of the operators that SQL can express: op2, op3, op4, op5 and op9.

Written from the contract alone, window by window, with nothing of the operators' methods. It serves the small tables;
op3's verdict takes its limits from op3_quality.
"""

from __future__ import annotations

from .op3_quality import LIMITS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def merged(size: int) -> str:
    """Maximal runs [a, b) of units from the starts of windows of that size."""
    return (
        f"cuts AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {size} THEN 0 ELSE 1 END AS cut FROM starts),"
        f" runs AS (SELECT rid, min(i) AS a, max(i) + {size} AS b FROM (SELECT rid, i, sum(cut) OVER (PARTITION BY rid ORDER BY i) AS g FROM cuts) c GROUP BY rid, g),"
        " gone AS (SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid),"
        " ends AS (SELECT rid, a, b FROM runs UNION ALL SELECT rid, n + 1, n + 1 FROM d),"
        " gaps AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a, b), 1) AS a, a AS b FROM ends)"
    )


OP2 = (
    f"WITH d AS (SELECT rid, doc_id, ws, len(ws) AS n FROM (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents) x),"
    " windows AS (SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, n - 33)) AS i FROM d) x),"
    " starts AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS times FROM windows) x WHERE times > 1),"
    f" {merged(35)},"
    " kept AS (SELECT g.rid, string_agg(array_to_string(d.ws[g.a:g.b - 1], ' '), ' ' ORDER BY g.a) AS t FROM gaps g JOIN d ON d.rid = g.rid WHERE g.b > g.a GROUP BY g.rid)"
    " SELECT d.doc_id, d.n AS n_words, coalesce(gone.n_removed, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256"
    " FROM d LEFT JOIN gone ON gone.rid = d.rid LEFT JOIN kept ON kept.rid = d.rid"
)

OP9 = (
    "WITH d AS (SELECT rid, doc_id, b, length(b) // 2 AS n FROM (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents) x),"
    " windows AS (SELECT rid, doc_id, i, substr(b, 2 * i - 1, 100) AS s FROM (SELECT rid, doc_id, b, unnest(range(1, n - 48)) AS i FROM d) x),"
    " starts AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_doc FROM windows) x WHERE first_doc < doc_id),"
    f" {merged(50)},"
    " kept AS (SELECT g.rid, string_agg(substr(d.b, 2 * g.a - 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS t FROM gaps g JOIN d ON d.rid = g.rid WHERE g.b > g.a GROUP BY g.rid)"
    " SELECT d.doc_id, d.n AS n_bytes, coalesce(gone.n_removed, 0) AS n_removed, coalesce(gone.n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.t, ''))) AS kept_sha256"
    " FROM d LEFT JOIN gone ON gone.rid = d.rid LEFT JOIN kept ON kept.rid = d.rid"
)


def covered(size: int, name: str) -> str:
    """Words in windows of that size that are found twice or more in the same text."""
    return (
        f"{name} AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest(range(0, {size})) AS k FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS times FROM"
        f" (SELECT rid, i, array_to_string(ws[i:i + {size - 1}], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, n - {size - 2})) AS i FROM d) w) x) y WHERE times > 1) z GROUP BY rid)"
    )


MIN_REPEAT, MAX_COVERED, LONG_WORDS, LONG_PERCENT = LIMITS
#: The longest repeat by halving, where one of MIN_REPEAT words exists: whether there is one of m words is monotone in m.
OP3 = (
    f"WITH RECURSIVE d AS (SELECT rid, doc_id, text, ws, len(ws) AS n FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents) x),"
    f" {covered(5, 'five')}, {covered(MIN_REPEAT, 'long')},"
    f" search AS (SELECT long.rid, CAST({MIN_REPEAT} AS BIGINT) AS lo, d.n - 1 AS hi FROM long JOIN d ON d.rid = long.rid UNION ALL"
    " SELECT rid, CASE WHEN twice THEN mid ELSE lo END, CASE WHEN twice THEN hi ELSE mid - 1 END FROM (SELECT rid, lo, hi, mid, len(list_distinct(h)) < len(h) AS twice FROM"
    " (SELECT s.rid, s.lo, s.hi, s.mid, list_transform(range(1, d.n - s.mid + 2), lambda i: hash(array_to_string(list_slice(d.ws, i, i + s.mid - 1), ' '))) AS h FROM"
    " (SELECT rid, lo, hi, (lo + hi + 1) // 2 AS mid FROM search WHERE lo < hi) s JOIN d ON d.rid = s.rid) x) y),"
    " top AS (SELECT rid, lo AS longest FROM search WHERE lo = hi),"
    r" lines AS (SELECT rid, count(*) - count(DISTINCT l) AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) x WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),"
    r" m AS (SELECT d.doc_id, d.n AS n_words, CAST(length(array_to_string(d.ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,"
    " coalesce(lines.dup, 0) AS n_dup_lines, coalesce(five.n, 0) AS n_repeat_words, coalesce(long.n, 0) AS covered_words, coalesce(top.longest, 0) AS longest_repeat"
    " FROM d LEFT JOIN top ON top.rid = d.rid LEFT JOIN lines ON lines.rid = d.rid LEFT JOIN five ON five.rid = d.rid LEFT JOIN long ON long.rid = d.rid)"
    " SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
    f" OR 100 * covered_words > {MAX_COVERED} * n_words OR (longest_repeat > {LONG_WORDS} AND 100 * longest_repeat > {LONG_PERCENT} * n_words)) AS kept FROM m"
)

PLAIN = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4 = (
    f"WITH d AS (SELECT rid, doc_id, ws, len(ws) AS n FROM (SELECT row_number() OVER () AS rid, doc_id, {PLAIN} AS ws FROM documents) x),"
    f" items AS (SELECT item_id, ws, least(len(ws), 10) AS size FROM (SELECT item_id, {PLAIN} AS ws FROM benchmark) x WHERE len(ws) > 0),"
    " phrases AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS s FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM items) x),"
    " windows AS (SELECT rid, i, size, array_to_string(ws[i:i + size - 1], ' ') AS s FROM (SELECT d.rid, d.ws, z.size, unnest(range(1, d.n - z.size + 2)) AS i FROM d, (SELECT DISTINCT size FROM phrases) z) x),"
    " found AS (SELECT w.rid, w.i, w.size, p.item_id FROM windows w JOIN phrases p ON p.size = w.size AND p.s = w.s),"
    " hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, i + unnest(range(0, size)) AS p FROM found) x GROUP BY rid),"
    " named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) x GROUP BY rid)"
    " SELECT d.doc_id, d.n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated"
    " FROM d LEFT JOIN hits ON hits.rid = d.rid LEFT JOIN named ON named.rid = d.rid"
)

OP5 = (
    rf"WITH RECURSIVE d AS (SELECT rid, doc_id, ws, len(ws) AS n FROM (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS ws FROM documents) x),"
    " grams AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, greatest(n - 3, 2))) AS i FROM d WHERE n > 0) x),"
    " sets AS (SELECT rid, count(*) AS n_shingles, sha256(string_agg(s, chr(10) ORDER BY s)) AS cls FROM grams GROUP BY rid),"
    " classes AS (SELECT cls, min(rid) AS rid, any_value(n_shingles) AS size FROM sets GROUP BY cls),"
    " held AS (SELECT c.cls, c.size, g.s FROM classes c JOIN grams g ON g.rid = c.rid),"
    " links AS (SELECT a, b FROM (SELECT x.cls AS a, y.cls AS b, any_value(x.size + y.size) AS total, count(*) AS common FROM held x JOIN held y ON x.s = y.s AND x.cls <> y.cls GROUP BY x.cls, y.cls) p"
    " WHERE 100 * common >= 80 * (total - common)),"
    " reach AS (SELECT cls AS a, cls AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),"
    " least AS (SELECT s.cls, min(d.doc_id) AS doc_id FROM sets s JOIN d ON d.rid = s.rid GROUP BY s.cls),"
    " named AS (SELECT r.a AS cls, min(l.doc_id) AS component_id FROM reach r JOIN least l ON l.cls = r.b GROUP BY r.a)"
    " SELECT d.doc_id, coalesce(s.n_shingles, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(l.doc_id, d.doc_id) AS class_id"
    " FROM d LEFT JOIN sets s ON s.rid = d.rid LEFT JOIN named m ON m.cls = s.cls LEFT JOIN least l ON l.cls = s.cls"
)

ORACLE_SQL: dict[str, str] = {"op2_substrings": OP2, "op3_quality": OP3, "op4_decontaminate": OP4, "op5_jaccard": OP5, "op9_parsing": OP9}
