"""Plans that check requests and model answers before anything is computed from them.

A request or answer is whole or it is refused: errors are values, so one bad request never stops a job.
"""

from __future__ import annotations

from ..functions import text as T
from ..functions.dialect import Spark
from .cues import cues
from .dialogue import spoken

MAX_WORD, MAX_TEXT = 100, 5000
#: One word, inner hyphens and apostrophes allowed.
ONE_WORD = r"^[\p{L}\p{Nl}\p{No}]+(?:['’\-][\p{L}\p{Nl}\p{No}]+)*$"
#: Names that a score may go by in an entry, in the order they are looked up.
SCORE_KEYS = ("modelProbability", "model_probability", "boundaryProbability", "boundary_probability", "probability")


def turns(d: Spark) -> str:
    """Turns of conversations as numbered cues of a request."""
    w = "OVER (PARTITION BY conv_id ORDER BY turn)"
    return (
        f"turns AS (SELECT conv_id, concat('c', CAST(turn AS VARCHAR(20))) AS id, CAST(row_number() {w} AS BIGINT) AS pos, count(*) OVER (PARTITION BY conv_id) AS n"
        f" FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) u)"
    )


def answers(d: Spark) -> str:
    """Groups of cue ids as a model gives them back, in the order given: some lack a cue, repeat one, invent one or turn the order round."""
    return (
        f"{turns(d)}, answers AS (SELECT conv_id, CASE WHEN conv_id % 7 = 2 THEN n - pos ELSE pos END AS place, CASE WHEN conv_id % 7 = 4 AND pos = 2 THEN 'x9' ELSE id END AS id FROM turns WHERE NOT (conv_id % 7 = 1 AND pos = 2)"
        f" UNION ALL SELECT conv_id, n + 1, id FROM turns WHERE conv_id % 7 = 3 AND pos = 1)"
    )


def grouping_errors(d: Spark) -> str:
    """Whether an answer's groups are a partition of the request's cues in order; the first broken rule, or null."""
    return (
        f"WITH {answers(d)}, met AS (SELECT a.conv_id, a.id, t.pos, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.place) AS nth FROM answers a LEFT JOIN turns t ON t.conv_id = a.conv_id AND t.id = a.id),"
        f" told AS (SELECT conv_id, count(*) AS items, count(DISTINCT id) AS ids, sum(CASE WHEN pos IS NULL THEN 1 ELSE 0 END) AS unknown, sum(CASE WHEN nth <> pos THEN 1 ELSE 0 END) AS moved FROM met GROUP BY conv_id),"
        f" due AS (SELECT conv_id, count(*) AS n_cues FROM turns GROUP BY conv_id)"
        f" SELECT due.conv_id, n_cues, coalesce(items, 0) AS n_items, CASE WHEN items <> ids THEN 'repeated cue' WHEN unknown > 0 THEN 'unknown cue' WHEN coalesce(items, 0) < n_cues THEN 'missing cue'"
        f" WHEN moved > 0 THEN 'cues out of order' END AS error FROM due LEFT JOIN told ON told.conv_id = due.conv_id"
    )


def entries(d: Spark) -> str:
    """Scores of the boundaries of a request as JSON: bare numbers or objects, some of them malformed, misplaced or left out."""
    at = "CAST(pos - 1 AS VARCHAR(20))"
    entry = (
        "CASE WHEN conv_id % 11 = 3 AND pos = 1 THEN '{\"leftIndex\": 5, \"probability\": 0.5}' WHEN conv_id % 11 = 5 AND pos = 1 THEN '{\"right_segment_id\": \"zz\", \"probability\": 0.5}'"
        f" ELSE CASE (conv_id + pos) % 9 WHEN 0 THEN concat('{{\"leftIndex\": ', {at}, ', \"probability\": 0.25}}') WHEN 1 THEN '0.5' WHEN 2 THEN '{{\"modelProbability\": null, \"probability\": 0.75}}'"
        " WHEN 3 THEN '{\"boundary_probability\": 1.5}' WHEN 4 THEN '\"0.4\"' WHEN 5 THEN 'true' WHEN 6 THEN concat('{\"leftSegmentId\": \"', id, '\", \"boundaryProbability\": 1}')"
        " WHEN 7 THEN '{\"probability\": \"0.3\"}' ELSE 'null' END END"
    )
    return (
        f"{turns(d)}, entries AS (SELECT conv_id, pos, {entry} AS entry FROM turns WHERE pos < n AND NOT (conv_id % 11 = 4 AND pos = n - 1)),"
        f" due AS (SELECT conv_id, pos, n - 1 AS expected, id AS lid, lead(id) OVER (PARTITION BY conv_id ORDER BY pos) AS rid, n FROM turns)"
    )


def model_evidence(d: Spark) -> str:
    """A probability for each boundary. A wrong number of entries or a misplaced one refuses the answer; a malformed score is null alone."""
    key = lambda k: f"variant_get(v, '$.{k}', 'variant')"
    text = lambda *ks: f"coalesce({', '.join(f'{key(k)}' for k in ks)})"
    score = f"CASE WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN coalesce({', '.join(key(k) for k in SCORE_KEYS)}) ELSE v END"
    off = lambda value, want: f"coalesce(NOT is_variant_null({value}) AND CAST({value} AS STRING) <> {want}, false)"
    return (
        f"WITH {entries(d)}, read AS (SELECT u.conv_id, u.pos, u.expected, u.lid, u.rid, e.entry, try_parse_json(e.entry) AS v FROM due u LEFT JOIN entries e ON e.conv_id = u.conv_id AND e.pos = u.pos WHERE u.pos < u.n),"
        f" found AS (SELECT conv_id, pos, expected, count(entry) OVER (PARTITION BY conv_id) AS received, {score} AS s,"
        f" {off(text('leftSegmentId', 'left_segment_id'), 'lid')} OR {off(text('rightSegmentId', 'right_segment_id'), 'rid')} OR {off(text('leftIndex', 'left_index'), 'CAST(pos - 1 AS STRING)')}"
        f" OR {off(text('rightIndex', 'right_index'), 'CAST(pos AS STRING)')} AS misplaced FROM read),"
        f" told AS (SELECT conv_id, pos - 1 AS boundary, CASE WHEN schema_of_variant(s) RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' THEN try_variant_get(s, '$', 'double') END AS p,"
        f" CASE WHEN received <> expected THEN 'wrong number of entries' WHEN max(misplaced) OVER (PARTITION BY conv_id) THEN 'entries out of order' END AS error FROM found)"
        f" SELECT conv_id, boundary, CASE WHEN error IS NULL AND p BETWEEN 0 AND 1 THEN p END AS p, error FROM told"
    )


def asked(d: Spark) -> str:
    """Similarity requests from documents: the third token and the first two lines, some of them spoilt."""
    lines = d.split("text", r"\n")
    return (
        f"asked AS (SELECT doc_id, trim(CASE doc_id % 9 WHEN 1 THEN 'two words' WHEN 2 THEN '  ' WHEN 3 THEN repeat('a', {MAX_WORD + 1}) WHEN 4 THEN 'x1' ELSE lower({d.item(d.extract_all('text', T.TOKEN), '3')}) END) AS word,"
        f" trim({d.item(lines, '1')}) AS one, trim(CASE WHEN doc_id % 9 = 5 THEN repeat('b ', {MAX_TEXT // 2 + 1}) ELSE {d.item(lines, '2')} END) AS two FROM documents WHERE text IS NOT NULL)"
    )


def similarity_request_errors(d: Spark) -> str:
    """Why a request is refused, a row for each field; whether the word occurs is asked only where all fields are sound."""
    texts = {f: f"CASE WHEN coalesce({f}, '') = '' THEN 'empty' WHEN length({f}) > {MAX_TEXT} THEN 'too long' END" for f in ("one", "two")}
    word = f"CASE WHEN coalesce(word, '') = '' THEN 'empty' WHEN length(word) > {MAX_WORD} THEN 'too long' WHEN NOT {d.match('word', ONE_WORD)} THEN 'not one word' END"
    absent = {f: f"CASE WHEN NOT {d.contains(d.transform(d.extract_all(f, T.TOKEN), 'x', 'lower(x)'), 'lower(word)')} THEN 'word absent' END" for f in ("one", "two")}
    rows = d.array(*(f"concat('{f}: ', {f}_error)" for f in ("word", "one", "two")))
    return (
        f"WITH {asked(d)}, sound AS (SELECT *, {word} AS word_error, {texts['one']} AS one_fault, {texts['two']} AS two_fault FROM asked),"
        f" judged AS (SELECT doc_id, word_error, CASE WHEN word_error IS NULL AND one_fault IS NULL AND two_fault IS NULL THEN {absent['one']} ELSE one_fault END AS one_error,"
        f" CASE WHEN word_error IS NULL AND one_fault IS NULL AND two_fault IS NULL THEN {absent['two']} ELSE two_fault END AS two_error FROM sound)"
        f" SELECT doc_id, error FROM (SELECT doc_id, explode({rows}) AS error FROM judged) a WHERE error IS NOT NULL"
    )


def fragment_errors(d: Spark) -> str:
    """Lines of documents as lists of fragments: none at all, blank ones, ones over 5,000 characters."""
    trimmed = d.transform(d.split("text", r"\n"), "x", "trim(x)")
    any_of = lambda c: f"{d.size(d.filter('parts', 'x', c))} > 0"
    blank, long = any_of("x = ''"), any_of(f"length(x) > {MAX_TEXT}")
    return (
        f"WITH lists AS (SELECT doc_id, {trimmed} AS parts FROM documents)"
        f" SELECT doc_id, CASE WHEN parts IS NULL THEN CAST(0 AS BIGINT) ELSE {d.size('parts')} END AS n,"
        f" CASE WHEN parts IS NULL THEN 'no fragments' WHEN {blank} THEN 'blank fragment' WHEN {long} THEN 'fragment too long' END AS error FROM lists"
    )


def supplied(d: Spark) -> str:
    """Cues with what a client says about them: raw text, speaker, several speakers, end."""
    return (
        f"{spoken(d)}, supplied AS (SELECT conv_id, turn, lines, names, shown_name, one, name, several, start_ms, CASE WHEN (conv_id + turn) % 23 = 5 THEN start_ms - 1 ELSE end_ms END AS end_ms,"
        " CASE WHEN (conv_id + turn) % 3 = 1 THEN " + d.join("lines", " ") + " WHEN (conv_id + turn) % 3 = 2 THEN " + d.join("lines", "\n") + " END AS raw_text,"
        " CASE conv_id % 4 WHEN 1 THEN ' ' || upper(shown_name) WHEN 2 THEN 'User' END AS said_speaker, CASE WHEN turn % 4 = 1 THEN true WHEN turn % 4 = 2 THEN false END AS said_several FROM spoken)"
    )


def segment_checks(d: Spark) -> str:
    """Cues of a request: times, raw text against lines, the client's speaker against the lines'; what the lines say of several speakers stands."""
    return (
        f"WITH {supplied(d)} SELECT conv_id, turn, CASE WHEN end_ms < start_ms THEN 'end before start' WHEN raw_text <> {d.join('lines', chr(10))} THEN 'raw text is not the lines'"
        f" WHEN one AND lower(trim(said_speaker)) <> name THEN 'another speaker than the lines' END AS error,"
        f" coalesce(said_speaker, CASE WHEN one THEN shown_name END) AS speaker, CASE WHEN several THEN true WHEN said_several THEN false ELSE said_several END AS several FROM supplied"
    )


def offset_checks(d: Spark) -> str:
    """Offsets of the boundaries in the joined text of a source: as many as boundaries, strictly rising, inside the text."""
    w = "OVER (PARTITION BY source_id ORDER BY ordinal)"
    spoilt = "CASE WHEN source_id % 10 = 3 AND ordinal = 1 THEN 0 WHEN source_id % 10 = 4 AND ordinal = 0 THEN 1000000000 ELSE spot END"
    return (
        f"WITH {cues(d)}, placed AS (SELECT source_id, ordinal, count(*) OVER (PARTITION BY source_id) AS n, CAST(sum(length(cue) + 1) {w} - 2 AS BIGINT) AS spot, CAST(sum(length(cue) + 1) OVER (PARTITION BY source_id) - 1 AS BIGINT) AS chars FROM cues),"
        f" given AS (SELECT source_id, ordinal, n, chars, CAST({spoilt} AS BIGINT) AS spot FROM placed WHERE NOT (ordinal = n - 1 AND n > 1) AND NOT (source_id % 10 = 5 AND ordinal = 2)),"
        f" beside AS (SELECT *, lag(spot) {w} AS before FROM given), told AS (SELECT source_id, n, count(CASE WHEN n > 1 THEN spot END) AS given, sum(CASE WHEN n > 1 AND before >= spot THEN 1 ELSE 0 END) AS falls,"
        f" sum(CASE WHEN n > 1 AND (spot < 0 OR spot >= chars) THEN 1 ELSE 0 END) AS outside FROM beside GROUP BY source_id, n)"
        f" SELECT source_id, n - 1 AS expected, given, CASE WHEN given <> n - 1 THEN 'wrong number of offsets' WHEN falls > 0 THEN 'offsets not rising' WHEN outside > 0 THEN 'offset outside the text' END AS error FROM told"
    )


def reference_gaps(d: Spark) -> str:
    """Cues that a candidate names (left, right, up to three of context on each side) and the reference cues lack."""
    w = "OVER (PARTITION BY source_id ORDER BY ordinal)"
    named = d.unnest(d.upto("8"), "source_id, ordinal, last", "candidates", "k", "step")
    anti = "LEFT ANTI JOIN" if d.name == "spark" else "ANTI JOIN"
    return (
        f"WITH {cues(d)}, candidates AS (SELECT source_id, ordinal, last FROM (SELECT source_id, ordinal, lead(ordinal) {w} AS nxt, max(ordinal) OVER (PARTITION BY source_id) AS last FROM cues) a WHERE nxt IS NOT NULL),"
        f" reference AS (SELECT source_id, ordinal AS cue FROM cues WHERE {d.mod('source_id * 13 + ordinal * 7', '97')} <> 0), named AS (SELECT source_id, ordinal, ordinal - 3 + k AS cue, k FROM ({named}) b WHERE ordinal - 3 + k BETWEEN 0 AND last)"
        f" SELECT c.source_id, c.ordinal, c.cue, CASE WHEN c.k < 3 THEN 'previous' WHEN c.k = 3 THEN 'left' WHEN c.k = 4 THEN 'right' ELSE 'next' END AS side FROM named c {anti} reference r ON r.source_id = c.source_id AND r.cue = c.cue"
    )


PLANS = (grouping_errors, model_evidence, similarity_request_errors, fragment_errors, segment_checks, offset_checks, reference_gaps)
