"""Plans for the labelling workflow: ledger, review state, queues, metrics, maturity, sampling."""

from __future__ import annotations

from ..functions.dialect import Spark
from .cues import decisions, scenes_of
from .similarity import ratio

LABELS = ("JOIN", "BREAK", "AMBIGUOUS")


def pick(d: Spark, key: str, values: tuple[str, ...]) -> str:
    return d.item(d.array(*(f"'{v}'" for v in values)), f"1 + {d.mod(key, str(len(values)))}")


def ledger(d: Spark) -> str:
    """The events table read as an append-only review ledger, three events on a boundary; event_id is the order of events. Some events break rules."""
    kind = "CASE WHEN event_id % 43 = 7 THEN 'note' WHEN event_id % 10 = 9 THEN 'adjudication' ELSE 'review' END"
    return (
        f"ledger AS (SELECT event_id AS seq, {kind} AS event_type, concat('b', CAST({d.div('event_id', '3')} * 2 AS VARCHAR(20))) AS boundary_id,"
        f" CAST({d.div('event_id', '3')} * 2 AS BIGINT) AS b, CASE WHEN event_id % 47 = 3 THEN '' ELSE concat('rv', CAST({d.div('event_id', '2')} + event_id % 2 * 100000 - (CASE WHEN event_id % 59 = 4 THEN 2 ELSE 0 END) AS VARCHAR(12))) END AS review_id,"
        f" CASE WHEN event_id % 53 = 11 THEN '' ELSE {pick(d, 'event_id * 7 + user_id', ('ana', 'ben', 'cruz', 'dia'))} END AS reviewer,"
        f" CASE WHEN event_id % 20 = 9 THEN NULL WHEN event_id % 37 = 5 THEN CAST(3 AS BIGINT) ELSE CAST(1 + event_id % 2 AS BIGINT) END AS round,"
        f" {pick(d, 'event_id * 5 + user_id * 3', (*LABELS, 'JOIN', 'MAYBE'))} AS label, {pick(d, 'event_id * 3 + user_id', ('high', 'medium', 'low', 'high', 'medium', 'sure'))} AS confidence,"
        " CASE WHEN event_id % 41 = 0 THEN '' ELSE event_type END AS reason, CASE WHEN event_id % 29 = 0 THEN 'unknown' ELSE 'human' END AS origin, CASE WHEN event_id % 61 = 8 THEN NULL ELSE ts END AS created_at FROM events)"
    )


#: Rules that each event of a known type and boundary must hold to; the first two decide what an event is checked for at all.
ROW_RULES = (
    ("duplicate reviewId", "review_id <> '' AND nth > 1"),
    ("missing reviewId", "review_id = ''"),
    ("missing reviewerId", "reviewer = ''"),
    ("invalid reviewRound", "event_type = 'review' AND (round IS NULL OR round < 1)"),
    ("reviewRound not 1 or 2", "event_type = 'review' AND round > 2"),
    ("adjudication must not have reviewRound", "event_type = 'adjudication' AND round IS NOT NULL"),
    ("invalid label", "label NOT IN ('JOIN', 'BREAK', 'AMBIGUOUS')"),
    ("invalid confidence", "confidence NOT IN ('high', 'medium', 'low')"),
    ("invalid labelOrigin", "origin <> 'human'"),
    ("missing or empty reason", "reason = ''"),
    ("missing createdAt", "created_at IS NULL"),
)


def checked() -> str:
    """Events of the CTE `ledger` beside the candidates of the CTE `known`."""
    return (
        "typed AS (SELECT l.*, k.bid IS NOT NULL AS known FROM ledger l LEFT JOIN known k ON k.bid = l.boundary_id),"
        " valid AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY seq) AS nth FROM typed WHERE event_type IN ('review', 'adjudication') AND known)"
    )


def errors_of(d: Spark) -> str:
    """One row for each broken rule: of an event (its seq), or of a boundary's events (seq -1)."""
    flags = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in ROW_RULES)
    of = "OVER (PARTITION BY boundary_id)"
    return (
        f"{checked()}, noted AS (SELECT *, sum(CASE WHEN round = 1 THEN 1 ELSE 0 END) {of} AS ones, min(CASE WHEN round = 1 THEN seq END) {of} AS first_one, min(CASE WHEN round = 2 THEN seq END) {of} AS first_two FROM valid),"
        f" latest AS (SELECT boundary_id, reviewer, label FROM (SELECT *, row_number() OVER (PARTITION BY boundary_id, reviewer ORDER BY seq DESC) AS back FROM valid WHERE event_type = 'review' AND reviewer <> '' AND label <> '') x WHERE back = 1),"
        f" opinions AS (SELECT boundary_id, count(DISTINCT label) AS n FROM latest GROUP BY boundary_id)"
        f" SELECT boundary_id, seq, CASE WHEN event_type NOT IN ('review', 'adjudication') THEN 'unknown eventType' ELSE 'unknown boundaryId' END AS error FROM typed WHERE event_type NOT IN ('review', 'adjudication') OR NOT known"
        f" UNION ALL SELECT boundary_id, seq, error FROM (SELECT boundary_id, seq, explode(array_compact(array({flags}))) AS error FROM valid) r"
        f" UNION ALL SELECT boundary_id, -1, 'one reviewer did both rounds' FROM valid WHERE event_type = 'review' AND reviewer <> '' GROUP BY boundary_id, reviewer HAVING count(DISTINCT CASE WHEN round IN (1, 2) THEN round END) = 2"
        f" UNION ALL SELECT boundary_id, seq, 'round two without round one' FROM noted WHERE round = 2 AND ones = 0"
        f" UNION ALL SELECT boundary_id, -1, 'round two before round one' FROM noted GROUP BY boundary_id HAVING max(CASE WHEN seq = first_one THEN created_at END) > max(CASE WHEN seq = first_two THEN created_at END)"
        f" UNION ALL SELECT v.boundary_id, -1, 'adjudication without disagreement' FROM (SELECT DISTINCT boundary_id FROM valid WHERE event_type = 'adjudication') v LEFT JOIN opinions o ON o.boundary_id = v.boundary_id WHERE coalesce(o.n, 0) < 2"
        f" UNION ALL SELECT r.boundary_id, r.seq, 'review after adjudication' FROM valid a JOIN valid r ON r.boundary_id = a.boundary_id AND r.created_at > a.created_at WHERE a.event_type = 'adjudication' AND r.event_type = 'review'"
        f" UNION ALL SELECT boundary_id, -1, 'several reviews of one reviewer and round' FROM valid WHERE event_type = 'review' AND reviewer <> '' AND round IS NOT NULL GROUP BY boundary_id, reviewer, round HAVING count(*) > 1"
    )


def ledger_errors(d: Spark) -> str:
    """Every broken rule of the ledger's events; the documents are the candidates."""
    return f"WITH {ledger(d)}, known AS (SELECT DISTINCT concat('b', CAST(doc_id AS VARCHAR(20))) AS bid FROM documents), {errors_of(d)}"


def states(d: Spark) -> str:
    return f"{ledger(d)}, {states_of(d)}"


def states_of(d: Spark) -> str:
    """The last adjudication wins; else the latest review of each reviewer: one, several that agree, or a disagreement without a label."""
    by = "PARTITION BY boundary_id, reviewer"
    doubt = lambda label, conf: f"CASE WHEN {conf} = 'low' THEN 'AMBIGUOUS' ELSE {label} END"
    said = "concat('R', reviewer, ': ', label, ' (', reason, ')')"
    return (
        f"reviews AS (SELECT *, row_number() OVER ({by} ORDER BY seq DESC) AS back, min(seq) OVER ({by}) AS first_seq FROM ledger WHERE event_type = 'review' AND round IN (1, 2) AND reviewer <> ''),"
        f" summed AS (SELECT boundary_id, count(*) AS reviewers, count(DISTINCT label) AS labels, {d.least_by('label', 'first_seq')} AS label, {d.least_by('confidence', 'first_seq')} AS confidence, {d.least_by('reason', 'first_seq')} AS reason,"
        f" {d.listagg(said, '; ', 'first_seq')} AS said FROM reviews WHERE back = 1 GROUP BY boundary_id),"
        f" ruled AS (SELECT boundary_id, {d.greatest_by('label', 'seq')} AS label, {d.greatest_by('confidence', 'seq')} AS confidence, {d.greatest_by('reason', 'seq')} AS reason FROM ledger WHERE event_type = 'adjudication' GROUP BY boundary_id),"
        f" every AS (SELECT DISTINCT boundary_id FROM ledger), known AS (SELECT e.boundary_id, a.boundary_id IS NOT NULL AS judged, coalesce(s.reviewers, 0) AS n, s.labels, s.said,"
        f" a.label AS al, a.confidence AS ac, a.reason AS ar, s.label AS sl, s.confidence AS sc, s.reason AS sr FROM every e LEFT JOIN ruled a ON a.boundary_id = e.boundary_id LEFT JOIN summed s ON s.boundary_id = e.boundary_id),"
        f" states AS (SELECT boundary_id, CASE WHEN judged THEN {doubt('al', 'ac')} WHEN n = 1 THEN sl WHEN labels = 1 THEN {doubt('sl', 'sc')} END AS gold_label,"
        f" CASE WHEN judged THEN ac WHEN n = 1 OR labels = 1 THEN sc END AS label_confidence, n AS reviewer_count, NOT judged AND n = 1 AND sl = 'JOIN' AND sc IN ('medium', 'low') AS needs_second_review,"
        f" CASE WHEN judged THEN ar WHEN n = 0 THEN '' WHEN n = 1 THEN sr WHEN labels = 1 THEN CASE WHEN sr = '' THEN 'Agreed' ELSE concat('Agreed: ', sr) END ELSE concat('Disagreement: ', said) END AS review_reason,"
        f" CASE WHEN judged THEN 'adjudicated' WHEN n = 0 THEN 'unreviewed' WHEN n = 1 OR labels = 1 THEN 'reviewed' ELSE 'needs_adjudication' END AS review_status, CASE WHEN judged OR n > 0 THEN 'human' END AS label_origin FROM known)"
    )


def review_state(d: Spark) -> str:
    return f"WITH {states(d)} SELECT boundary_id, gold_label, label_confidence, reviewer_count, coalesce(needs_second_review, false) AS needs_second_review, review_reason, review_status, label_origin FROM states"


#: Entries whose label, status and origin must agree, some of them spoilt.
SPOILT = (
    "entries AS (SELECT boundary_id, CASE WHEN b % 31 = 0 THEN 'MAYBE' ELSE gold_label END AS gold_label, CASE WHEN b % 17 = 0 THEN NULL WHEN b % 19 = 0 THEN 'model' ELSE label_origin END AS origin,"
    " CASE WHEN b % 23 = 0 THEN 'done' WHEN b % 29 = 0 THEN 'unreviewed' WHEN b % 13 = 0 THEN 'needs_adjudication' ELSE review_status END AS status FROM (SELECT *, CAST(substr(boundary_id, 2) AS BIGINT) AS b FROM states) x)"
)
ORIGIN_RULES = (
    ("goldLabel but labelOrigin is null", "gold_label IS NOT NULL AND origin IS NULL"),
    ("goldLabel but labelOrigin is not human", "gold_label IS NOT NULL AND origin IS NOT NULL AND origin <> 'human'"),
    ("unreviewed but labelOrigin", "status = 'unreviewed' AND origin IS NOT NULL"),
    ("reviewed without human labelOrigin", "status IN ('reviewed', 'adjudicated') AND coalesce(origin, '') <> 'human'"),
    ("needs_adjudication but goldLabel", "status = 'needs_adjudication' AND gold_label IS NOT NULL"),
    ("invalid goldLabel", "gold_label IS NOT NULL AND gold_label NOT IN ('JOIN', 'BREAK', 'AMBIGUOUS')"),
    ("invalid reviewStatus", "status NOT IN ('unreviewed', 'reviewed', 'needs_adjudication', 'adjudicated')"),
)


def label_origin_errors(d: Spark) -> str:
    flags = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in ORIGIN_RULES)
    return f"WITH {states(d)}, {SPOILT} SELECT boundary_id, explode(array_compact(array({flags}))) AS error FROM entries"


CANDIDATES = "candidates AS (SELECT concat('b', CAST(doc_id AS VARCHAR(20))) AS boundary_id, source, doc_id AS cue FROM documents)"


#: Turns counted together, so that a running count over all turns is one over chunks of them.
CHUNK = 4096


def dealt(d: Spark, rows: str, key: str, turn: str, tie: str) -> str:
    """The CTE `dealt`: rows with their place in the order (key, turn, tie), without a window over all rows.

    Rows of a turn are numbered among themselves; what comes before a turn is the sum of smaller chunks of turns and of
    smaller turns of its chunk. The one window over everything has a row for each chunk, 4,096 times fewer than turns.
    """
    chunk = d.div(turn, str(CHUNK))
    return (
        f"sizes AS (SELECT {key} AS z_key, {turn} AS z_turn, {chunk} AS z_chunk, count(*) AS c FROM {rows} GROUP BY {key}, {turn}), chunks AS (SELECT z_key, z_chunk, sum(c) AS c FROM sizes GROUP BY z_key, z_chunk),"
        f" starts AS (SELECT z_key, z_chunk, sum(c) OVER (ORDER BY z_key, z_chunk) - c AS before FROM chunks),"
        f" earlier AS (SELECT s.z_key, s.z_turn, b.before + sum(s.c) OVER (PARTITION BY s.z_key, s.z_chunk ORDER BY s.z_turn) - s.c AS before FROM sizes s JOIN starts b ON b.z_key = s.z_key AND b.z_chunk = s.z_chunk),"
        f" numbered AS (SELECT *, row_number() OVER (PARTITION BY {key}, {turn} ORDER BY {tie}) AS z_at FROM {rows}),"
        f" dealt AS (SELECT n.*, e.before + n.z_at AS place FROM numbered n JOIN earlier e ON e.z_key = n.{key} AND e.z_turn = n.{turn})"
    )


def round1_queue(d: Spark) -> str:
    """Candidates that nobody has reviewed, dealt round-robin over sources; ranks are set before the filter, so batches never shift."""
    return (
        f"WITH {ledger(d)}, {CANDIDATES}, ranked AS (SELECT *, 0 AS tier, row_number() OVER (PARTITION BY source ORDER BY cue, boundary_id) AS rn FROM candidates), {dealt(d, 'ranked', 'tier', 'rn', 'source')}"
        f" SELECT p.boundary_id, p.source, CAST(p.place AS BIGINT) AS place, CAST({d.div('p.place - 1', '25')} AS BIGINT) AS batch FROM dealt p LEFT ANTI JOIN ledger l ON l.boundary_id = p.boundary_id"
    )


def round2_queue(d: Spark) -> str:
    """What ana reviews second: first reviewed by another, without a second review or a ruling, not seen by ana; a fifth of the split.

    Doubtful labels first; within a tier the sources take turns.
    """
    tier = "CASE WHEN label = 'JOIN' AND confidence = 'medium' THEN 0 WHEN label = 'JOIN' AND confidence = 'low' THEN 1 ELSE 3 END"
    return (
        f"WITH {ledger(d)}, split AS (SELECT concat('b', CAST(doc_id AS VARCHAR(20))) AS boundary_id, source, doc_id AS cue FROM documents WHERE doc_id % 3 <> 0),"
        f" histories AS (SELECT boundary_id, min(CASE WHEN event_type = 'review' AND round = 1 THEN seq END) AS first_seq, max(CASE WHEN event_type = 'review' AND reviewer = 'ana' THEN 1 ELSE 0 END) AS own,"
        f" max(CASE WHEN event_type = 'adjudication' OR event_type = 'review' AND round = 2 THEN 1 ELSE 0 END) AS closed FROM ledger GROUP BY boundary_id),"
        f" open AS (SELECT s.boundary_id, s.source, s.cue, {tier} AS tier FROM histories h JOIN ledger l ON l.seq = h.first_seq JOIN split s ON s.boundary_id = h.boundary_id WHERE h.own = 0 AND h.closed = 0),"
        f" turns AS (SELECT *, row_number() OVER (PARTITION BY tier, source ORDER BY cue) AS turn FROM open), {dealt(d, 'turns', 'tier', 'turn', 'source')}"
        f" SELECT boundary_id, source, CAST(tier AS BIGINT) AS tier, CAST(place AS BIGINT) AS place FROM dealt WHERE place <= (SELECT greatest(1, {d.div('count(*)', '5')}) FROM split)"
    )


def queue_content_hash(d: Spark) -> str:
    """Batches of 25 candidates of a source: rows as JSON in order, with the separators that hashes are taken over."""
    row = """concat('{"boundaryId": "', boundary_id, '", "cue": ', CAST(cue AS VARCHAR(20)), ', "source": "', source, '"}')"""
    return (
        f"WITH {CANDIDATES}, rows_of AS (SELECT source, CAST({d.div('rn - 1', '25')} AS BIGINT) AS batch, cue, {row} AS line FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cue) AS rn FROM candidates) a)"
        f" SELECT source, batch, count(*) AS row_count, {d.sha256('concat(' + repr('[') + ', ' + d.listagg('line', ', ', 'cue') + ', ' + repr(']') + ')')} AS content_sha256 FROM rows_of GROUP BY source, batch"
    )


def judged(d: Spark) -> str:
    """Decisions against synthetic gold labels: AMBIGUOUS cases leave, then the first of each (left, right, gap) is kept."""
    gold = d.mod("ordinal * 3 + gap_ms", "7")
    return (
        f"{decisions(d)}, cases AS (SELECT source_id, ordinal, lcue, rcue, gap_ms, lang, band, upper(decision) AS predicted, CASE WHEN {gold} < 2 THEN 'JOIN' WHEN {gold} = 6 THEN 'AMBIGUOUS' ELSE 'BREAK' END AS expected FROM decisions),"
        f" kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lcue, rcue, gap_ms ORDER BY source_id, ordinal) AS r FROM cases WHERE expected <> 'AMBIGUOUS') a WHERE r = 1)"
    )


def metrics() -> str:
    def count(c: str) -> str:
        return f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"

    hit, said, due = count("predicted = 'JOIN' AND expected = 'JOIN'"), count("predicted = 'JOIN'"), count("expected = 'JOIN'")
    held, breaks = count("predicted <> 'JOIN' AND expected = 'BREAK'"), count("expected = 'BREAK'")
    return (
        f"count(*) AS n, {ratio(hit, said)} AS join_precision, {ratio(hit, due)} AS join_recall, {ratio(held, breaks)} AS break_accuracy,"
        f" {count(chr(112) + 'redicted = ' + repr('JOIN') + ' AND expected = ' + repr('BREAK'))} AS false_merges, {due} - {hit} AS missed_joins"
    )


def boundary_metrics(d: Spark) -> str:
    return f"WITH {judged(d)} SELECT {metrics()} FROM kept"


def stratified_metrics(d: Spark) -> str:
    return f"WITH {judged(d)} SELECT coalesce(lang, '*') AS lang, coalesce(band, '*') AS band, {metrics()} FROM kept GROUP BY GROUPING SETS ((lang), (band), (lang, band), ())"


def cohen_kappa(d: Spark) -> str:
    return (
        "WITH pairs AS (SELECT CAST(quality AS BIGINT) AS a, CAST(toxic AS BIGINT) AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), s AS (SELECT count(*) AS n, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS DOUBLE) AS same,"
        " CAST(sum(a) AS DOUBLE) AS sa, CAST(sum(b) AS DOUBLE) AS sb FROM pairs), e AS (SELECT n, same / n AS po, (sa / n) * (sb / n) + (1 - sa / n) * (1 - sb / n) AS pe FROM s)"
        " SELECT n, round(po, 6) AS agreement, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM e"
    )


def maturity_level(d: Spark) -> str:
    """The ladder none, exploratory, usable, validated, for all entries and for each language; the policy counts as frozen."""
    n = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
    done = "status IN ('reviewed', 'adjudicated')"
    plain = f"{done} AND coalesce(gold_label, 'AMBIGUOUS') <> 'AMBIGUOUS'"
    return (
        f"WITH {states(d)}, entries AS (SELECT c.lang, c.source, coalesce(s.review_status, 'unreviewed') AS status, s.gold_label, coalesce(s.reviewer_count, 0) AS reviewers, s.label_origin AS origin,"
        f" {pick(d, 'c.doc_id', ('dev', 'dev', 'test'))} AS split, {pick(d, 'c.doc_id * 3', ('0-100ms', '301-500ms', '501-1500ms', '3000+ms'))} AS timing_band, {pick(d, 'c.doc_id * 5', ('dialogue', 'monologue', 'unknown'))} AS structure,"
        f" {pick(d, 'c.doc_id * 7', ('independent_utterance', 'join_like', 'caption', 'misleading_period', 'starts_with_conjunction'))} AS tag, c.doc_id % 2 = 0 AS native"
        f" FROM documents c LEFT JOIN states s ON s.boundary_id = concat('b', CAST(c.doc_id AS VARCHAR(20)))),"
        f" t AS (SELECT coalesce(lang, '*') AS lang, {n(plain)} AS reviewed_non_ambiguous, count(DISTINCT source) AS productions, {n(done)} AS reviewed, {n('reviewers >= 2')} AS twice,"
        f" {n(f'{done} AND gold_label = {chr(39)}JOIN{chr(39)}')} AS reviewed_join, {n(f'{done} AND gold_label = {chr(39)}BREAK{chr(39)}')} AS reviewed_break, {n('status = ' + repr('needs_adjudication'))} AS needs_adjudication,"
        f" {n(f'{done} AND coalesce(origin, {chr(39) * 2}) <> {chr(39)}human{chr(39)}')} AS not_human, {n('native')} AS native_entries, count(DISTINCT timing_band) AS bands,"
        f" {n('tag IN (' + repr('independent_utterance') + ', ' + repr('caption') + ')')} AS break_like, {n('tag IN (' + repr('join_like') + ', ' + repr('misleading_period') + ')')} AS join_like,"
        f" count(DISTINCT CASE WHEN structure <> 'unknown' THEN structure END) AS structures, {n('split = ' + repr('dev'))} AS dev, {n('split = ' + repr('test'))} AS test,"
        f" {n(f'split = {chr(39)}dev{chr(39)} AND {done}')} AS dev_reviewed, {n(f'split = {chr(39)}test{chr(39)} AND {done}')} AS test_reviewed, {n(f'split = {chr(39)}test{chr(39)} AND {plain}')} AS test_plain"
        f" FROM entries GROUP BY GROUPING SETS ((lang), ())),"
        f" told AS (SELECT *, break_like > 0 AND join_like > 0 AS both_like FROM t)"
        f" SELECT lang, reviewed_non_ambiguous, productions, reviewed_join, reviewed_break, needs_adjudication, native_entries, {ratio('twice', 'reviewed')} AS second_review_share,"
        f" CASE WHEN reviewed_non_ambiguous >= 200 AND 5 * dev_reviewed >= 4 * dev AND dev > 0 AND 5 * test_reviewed >= 4 * test AND reviewed_join >= 20 AND reviewed_break >= 20 AND productions >= 2 AND structures = 2 AND test > 0"
        f" AND 5 * twice >= reviewed AND needs_adjudication = 0 AND native_entries >= 50 AND not_human = 0 THEN 'validated'"
        f" WHEN reviewed_non_ambiguous >= 150 AND productions >= 2 AND reviewed_join >= 10 AND reviewed_break >= 10 AND both_like AND bands >= 3 AND dev > 0 AND test > 0 AND test_plain >= 20 AND twice > 0 AND not_human = 0 THEN 'usable'"
        f" WHEN reviewed_non_ambiguous >= 75 AND reviewed_join >= 5 AND reviewed_break >= 5 AND both_like THEN 'exploratory' ELSE 'none' END AS maturity FROM told"
    )


def source_manifest_check(d: Spark) -> str:
    """Sources of the documents against those of a manifest: missing, unregistered, different counts."""
    return (
        "WITH files AS (SELECT source, count(*) AS n FROM documents GROUP BY source), manifest AS (SELECT source, n + CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS n FROM files WHERE source <> 'src5' UNION ALL SELECT 'src99', 1)"
        " SELECT coalesce(f.source, m.source) AS source, f.n AS found, m.n AS expected, CASE WHEN m.source IS NULL THEN 'unregistered' WHEN f.source IS NULL THEN 'missing' WHEN f.n <> m.n THEN 'count' ELSE 'ok' END AS status"
        " FROM files f FULL JOIN manifest m ON m.source = f.source"
    )


def scene_split(d: Spark) -> str:
    """Whole scenes go to dev or test, near 70 % of the cues of each source: by running share in hash order."""
    order = d.sha256("concat('42:', CAST(source_id AS VARCHAR(20)), ':', CAST(scene AS VARCHAR(20)))")
    w = f"OVER (PARTITION BY source_id ORDER BY {order})"
    return (
        f"WITH {scenes_of(d)}, shares AS (SELECT source_id, scene, n_cues, sum(n_cues) {w} - n_cues AS before, sum(n_cues) OVER (PARTITION BY source_id) AS total FROM scenes)"
        f" SELECT source_id, scene, n_cues, CASE WHEN before < 0.7 * total THEN 'dev' ELSE 'test' END AS split FROM shares"
    )


def append_ledger(d: Spark) -> str:
    """New events joined to the old: those whose review is known, or repeats a reviewer and round, stay out."""
    anti = "LEFT ANTI JOIN" if d.name == "spark" else "ANTI JOIN"
    return (
        f"WITH {ledger(d)}, old AS (SELECT * FROM ledger WHERE seq % 5 <> 0), fresh AS (SELECT * FROM ledger WHERE seq % 5 = 0),"
        f" allowed AS (SELECT f.* FROM fresh f {anti} old o ON o.review_id = f.review_id {anti} old p ON p.boundary_id = f.boundary_id AND p.reviewer = f.reviewer AND p.round = f.round AND p.event_type = f.event_type)"
        f" SELECT seq, boundary_id, review_id, 'old' AS part FROM old UNION ALL SELECT seq, boundary_id, review_id, 'new' AS part FROM allowed"
    )


#: Sections of the dataset report and the columns they count by.
SECTIONS = ("source", "lang", "split", "status", "origin")


def dataset_report(d: Spark) -> str:
    """Counts of candidates by source, language, split, review status and origin, most common first (ties by value), and in all."""
    section = "CASE " + " ".join(f"WHEN {c} IS NOT NULL THEN '{c}'" for c in SECTIONS) + " ELSE 'all' END"
    return (
        f"WITH {states(d)}, entries AS (SELECT coalesce(c.source, 'unknown') AS source, coalesce(c.lang, 'unknown') AS lang, CASE WHEN c.doc_id % 3 = 2 THEN 'test' ELSE 'dev' END AS split,"
        f" coalesce(s.review_status, 'unreviewed') AS status, coalesce(s.label_origin, 'none') AS origin FROM documents c LEFT JOIN states s ON s.boundary_id = concat('b', CAST(c.doc_id AS VARCHAR(20)))),"
        f" counted AS (SELECT {', '.join(SECTIONS)}, count(*) AS n FROM entries GROUP BY GROUPING SETS ({', '.join(f'({c})' for c in SECTIONS)}, ())),"
        f" facts AS (SELECT {section} AS section, coalesce({', '.join(SECTIONS)}, '*') AS entry, n FROM counted)"
        f" SELECT section, entry, n, CAST(row_number() OVER (PARTITION BY section ORDER BY n DESC, entry) AS BIGINT) AS place FROM facts"
    )


PLANS = (
    dataset_report, ledger_errors, review_state, label_origin_errors, round1_queue, round2_queue, queue_content_hash, boundary_metrics, stratified_metrics,
    cohen_kappa, maturity_level, source_manifest_check, scene_split, append_ledger,
)
