"""DuckDB SQL written by hand from the rules, beside the plans: only the fixtures (ledger, cues, spoken turns) are shared."""

from __future__ import annotations

from .functions.dialect import Duck
from .plans.cues import cues, proposed, signals_of
from .plans.dialogue import spoken
from .plans.imports import handed_in, manifests
from .plans.labelling import SPOILT, ledger, states
from .plans.readiness import entries as candidates, lacking, passes, sources
from .plans.requests import answers, asked, entries
from .plans.similarity import tokens

D = Duck()

LEDGER_ERRORS = f"""
WITH {ledger(D)},
lines AS (SELECT *, event_type IN ('review', 'adjudication') AS typed, boundary_id IN (SELECT 'b' || doc_id FROM documents) AS known FROM ledger),
good AS (SELECT * FROM lines WHERE typed AND known)
SELECT boundary_id, seq, 'unknown eventType' AS error FROM lines WHERE NOT typed
UNION ALL SELECT boundary_id, seq, 'unknown boundaryId' FROM lines WHERE typed AND NOT known
UNION ALL SELECT boundary_id, seq, 'duplicate reviewId' FROM good g WHERE review_id <> '' AND EXISTS (SELECT 1 FROM good o WHERE o.review_id = g.review_id AND o.seq < g.seq)
UNION ALL SELECT boundary_id, seq, 'missing reviewId' FROM good WHERE review_id = ''
UNION ALL SELECT boundary_id, seq, 'missing reviewerId' FROM good WHERE reviewer = ''
UNION ALL SELECT boundary_id, seq, 'invalid reviewRound' FROM good WHERE event_type = 'review' AND coalesce(round, 0) < 1
UNION ALL SELECT boundary_id, seq, 'reviewRound not 1 or 2' FROM good WHERE event_type = 'review' AND coalesce(round, 0) >= 1 AND round NOT IN (1, 2)
UNION ALL SELECT boundary_id, seq, 'adjudication must not have reviewRound' FROM good WHERE event_type = 'adjudication' AND round IS NOT NULL
UNION ALL SELECT boundary_id, seq, 'invalid label' FROM good WHERE label NOT IN ('JOIN', 'BREAK', 'AMBIGUOUS')
UNION ALL SELECT boundary_id, seq, 'invalid confidence' FROM good WHERE confidence NOT IN ('high', 'medium', 'low')
UNION ALL SELECT boundary_id, seq, 'invalid labelOrigin' FROM good WHERE origin <> 'human'
UNION ALL SELECT boundary_id, seq, 'missing or empty reason' FROM good WHERE coalesce(reason, '') = ''
UNION ALL SELECT boundary_id, seq, 'missing createdAt' FROM good WHERE created_at IS NULL
UNION ALL SELECT boundary_id, -1, 'one reviewer did both rounds' FROM (
  SELECT DISTINCT a.boundary_id, a.reviewer FROM good a JOIN good b ON a.boundary_id = b.boundary_id AND a.reviewer = b.reviewer
  WHERE a.reviewer <> '' AND a.event_type = 'review' AND b.event_type = 'review' AND a.round = 1 AND b.round = 2) x
UNION ALL SELECT boundary_id, seq, 'round two without round one' FROM good g WHERE round = 2 AND NOT EXISTS (SELECT 1 FROM good o WHERE o.boundary_id = g.boundary_id AND o.round = 1)
UNION ALL SELECT boundary_id, -1, 'round two before round one' FROM (
  SELECT boundary_id, (list(created_at ORDER BY seq) FILTER (WHERE round = 1))[1] AS t1, (list(created_at ORDER BY seq) FILTER (WHERE round = 2))[1] AS t2 FROM good GROUP BY boundary_id) x WHERE t1 > t2
UNION ALL SELECT boundary_id, -1, 'adjudication without disagreement' FROM (SELECT DISTINCT boundary_id FROM good WHERE event_type = 'adjudication') a
  WHERE (SELECT count(DISTINCT r.label) FROM good r WHERE r.boundary_id = a.boundary_id AND r.event_type = 'review' AND r.reviewer <> ''
    AND NOT EXISTS (SELECT 1 FROM good l WHERE l.boundary_id = r.boundary_id AND l.reviewer = r.reviewer AND l.event_type = 'review' AND l.seq > r.seq)) < 2
UNION ALL SELECT r.boundary_id, r.seq, 'review after adjudication' FROM good a, good r WHERE a.boundary_id = r.boundary_id AND a.event_type = 'adjudication' AND r.event_type = 'review' AND r.created_at > a.created_at
UNION ALL SELECT boundary_id, -1, 'several reviews of one reviewer and round' FROM (SELECT boundary_id, reviewer, round, count(*) AS n FROM good WHERE event_type = 'review' AND reviewer <> '' AND round IS NOT NULL GROUP BY ALL) x WHERE n > 1
"""

REVIEW_STATE = f"""
WITH {ledger(D)},
latest AS (SELECT boundary_id, reviewer, min(seq) AS since, arg_max(label, seq) AS label, arg_max(confidence, seq) AS confidence, arg_max(reason, seq) AS reason
  FROM ledger WHERE event_type = 'review' AND round BETWEEN 1 AND 2 AND reviewer <> '' GROUP BY ALL),
reviews AS (SELECT boundary_id, list({{'reviewer': reviewer, 'label': label, 'confidence': confidence, 'reason': reason}} ORDER BY since) AS rs FROM latest GROUP BY boundary_id),
rulings AS (SELECT boundary_id, list({{'label': label, 'confidence': confidence, 'reason': reason}} ORDER BY seq)[-1] AS a FROM ledger WHERE event_type = 'adjudication' GROUP BY boundary_id),
told AS (SELECT DISTINCT l.boundary_id, a, rs, coalesce(len(rs), 0) AS n, len(list_distinct(list_transform(rs, lambda r: r.label))) AS kinds
  FROM ledger l LEFT JOIN reviews v ON v.boundary_id = l.boundary_id LEFT JOIN rulings g ON g.boundary_id = l.boundary_id)
SELECT boundary_id,
  CASE WHEN a IS NOT NULL THEN if(a.confidence = 'low', 'AMBIGUOUS', a.label) WHEN n = 0 THEN NULL WHEN n = 1 THEN rs[1].label WHEN kinds > 1 THEN NULL WHEN rs[1].confidence = 'low' THEN 'AMBIGUOUS' ELSE rs[1].label END AS gold_label,
  CASE WHEN a IS NOT NULL THEN a.confidence WHEN n > 0 AND kinds = 1 THEN rs[1].confidence END AS label_confidence, n AS reviewer_count,
  a IS NULL AND n = 1 AND coalesce(rs[1].label = 'JOIN' AND rs[1].confidence IN ('medium', 'low'), false) AS needs_second_review,
  CASE WHEN a IS NOT NULL THEN a.reason WHEN n = 0 THEN '' WHEN n = 1 THEN rs[1].reason WHEN kinds = 1 THEN if(rs[1].reason = '', 'Agreed', 'Agreed: ' || rs[1].reason)
    ELSE 'Disagreement: ' || array_to_string(list_transform(rs, lambda r: 'R' || r.reviewer || ': ' || r.label || ' (' || r.reason || ')'), '; ') END AS review_reason,
  CASE WHEN a IS NOT NULL THEN 'adjudicated' WHEN n = 0 THEN 'unreviewed' WHEN kinds = 1 THEN 'reviewed' ELSE 'needs_adjudication' END AS review_status,
  if(a IS NOT NULL OR n > 0, 'human', NULL) AS label_origin
FROM told
"""

LABEL_ORIGIN_ERRORS = f"""
WITH {states(D)}, {SPOILT}
SELECT boundary_id, 'goldLabel but labelOrigin is null' AS error FROM entries WHERE gold_label IS NOT NULL AND origin IS NULL
UNION ALL SELECT boundary_id, 'goldLabel but labelOrigin is not human' FROM entries WHERE gold_label IS NOT NULL AND origin <> 'human'
UNION ALL SELECT boundary_id, 'unreviewed but labelOrigin' FROM entries WHERE status = 'unreviewed' AND origin IS NOT NULL
UNION ALL SELECT boundary_id, 'reviewed without human labelOrigin' FROM entries WHERE status IN ('reviewed', 'adjudicated') AND origin IS DISTINCT FROM 'human'
UNION ALL SELECT boundary_id, 'needs_adjudication but goldLabel' FROM entries WHERE status = 'needs_adjudication' AND gold_label IS NOT NULL
UNION ALL SELECT boundary_id, 'invalid goldLabel' FROM entries WHERE gold_label NOT IN ('JOIN', 'BREAK', 'AMBIGUOUS')
UNION ALL SELECT boundary_id, 'invalid reviewStatus' FROM entries WHERE status NOT IN ('unreviewed', 'reviewed', 'needs_adjudication', 'adjudicated')
"""

ROUND1_QUEUE = f"""
WITH {ledger(D)},
ranked AS (SELECT 'b' || doc_id AS boundary_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
placed AS (SELECT *, row_number() OVER (ORDER BY rn, source NULLS FIRST) AS place FROM ranked)
SELECT boundary_id, source, place, (place - 1) // 25 AS batch FROM placed WHERE boundary_id NOT IN (SELECT boundary_id FROM ledger)
"""

ROUND2_QUEUE = f"""
WITH {ledger(D)},
split AS (SELECT 'b' || doc_id AS boundary_id, source, doc_id FROM documents WHERE doc_id % 3 <> 0),
firsts AS (SELECT boundary_id, arg_min(reviewer, seq) AS reviewer, arg_min(label, seq) AS label, arg_min(confidence, seq) AS confidence FROM ledger WHERE event_type = 'review' AND round = 1 GROUP BY boundary_id),
eligible AS (SELECT s.*, CASE WHEN label = 'JOIN' AND confidence = 'medium' THEN 0 WHEN label = 'JOIN' AND confidence = 'low' THEN 1 ELSE 3 END AS tier FROM split s JOIN firsts f USING (boundary_id)
  WHERE f.reviewer <> 'ana' AND s.boundary_id NOT IN (SELECT boundary_id FROM ledger WHERE event_type = 'review' AND reviewer = 'ana')
  AND s.boundary_id NOT IN (SELECT boundary_id FROM ledger WHERE event_type = 'review' AND round = 2) AND s.boundary_id NOT IN (SELECT boundary_id FROM ledger WHERE event_type = 'adjudication')),
turns AS (SELECT e.*, (SELECT count(*) FROM eligible o WHERE o.tier = e.tier AND o.source IS NOT DISTINCT FROM e.source AND o.doc_id < e.doc_id) AS turn FROM eligible e),
placed AS (SELECT *, row_number() OVER (ORDER BY tier, turn, source NULLS FIRST) AS place FROM turns)
SELECT boundary_id, source, CAST(tier AS BIGINT) AS tier, place FROM placed WHERE place <= (SELECT greatest(1, floor(count(*) * 0.2)) FROM split)
"""

CUE_OVERLAP = f"""
WITH {cues(D)}, {proposed(D)},
ranges AS (SELECT n.source_id, n.s, min(c.ordinal) AS first_cue, max(c.ordinal) AS last_cue FROM sentences n JOIN spans c ON c.source_id = n.source_id AND c.start < n.stop AND n.start < c.stop GROUP BY ALL),
heads AS (SELECT source_id, s FROM ranges r WHERE NOT EXISTS (SELECT 1 FROM ranges b WHERE b.source_id = r.source_id AND b.s < r.s AND b.last_cue >= r.first_cue)),
grouped AS (SELECT r.*, (SELECT count(*) FROM heads h WHERE h.source_id = r.source_id AND h.s <= r.s) AS grp FROM ranges r)
SELECT source_id, grp, min(first_cue) AS first_cue, max(last_cue) AS last_cue, count(*) AS n_sentences FROM grouped GROUP BY ALL
"""

DIALOGUE = f"""
WITH {spoken(D)},
cue AS (SELECT *, CASE WHEN one THEN name END AS who, regexp_extract(cue_id, '^(.*?)([0-9]+)$', 1) AS head, TRY_CAST(regexp_extract(cue_id, '([0-9]+)$', 1) AS BIGINT) AS num, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM spoken),
pairs AS (SELECT l.conv_id, l.turn, 'en' AS lang, l.cue AS lcue, r.cue AS rcue, l.who AS lwho, r.who AS rwho, l.several AS lmany, r.several AS rmany, l.dashes + r.dashes > 0 AS dashed, l.head AS lhead, r.head AS rhead, l.num AS lnum, r.num AS rnum,
  r.start_ms < l.start_ms AS back, r.start_ms - l.end_ms AS gap_ms, CASE WHEN (l.conv_id * 31 + l.turn * 17) % 103 <= 100 THEN ((l.conv_id * 31 + l.turn * 17) % 103) / 100.0 END AS p
  FROM cue l JOIN cue r ON r.conv_id = l.conv_id AND r.i = l.i + 1), {signals_of(D, "pairs")},
reasoned AS (SELECT *, CASE WHEN dashed THEN greatest(score - 2, 0) ELSE score END AS points, CASE
  WHEN lwho <> rwho THEN 'adjacent cues have different explicit speakers'
  WHEN lmany THEN 'left cue contains multiple speakers' WHEN rmany THEN 'right cue contains multiple speakers'
  WHEN rwho IS NOT NULL AND lwho IS NULL THEN 'right cue introduces a new explicit speaker'
  WHEN back THEN 'cue order is invalid'
  WHEN lnum IS NOT NULL AND rnum IS NOT NULL AND lhead = rhead AND rnum <= lnum THEN 'cue order is invalid'
  WHEN lnum IS NOT NULL AND rnum IS NOT NULL AND lhead = rhead AND rnum > lnum + 1 THEN 'source cues are not consecutive'
  WHEN gap_ms > 30000 THEN 'cue gap ' || gap_ms || 'ms exceeds extreme-gap threshold 30000ms'
  WHEN issue IS NOT NULL THEN 'joining would corrupt text: ' || issue END AS hard FROM signals)
SELECT conv_id, turn, gap_ms, CAST(points AS BIGINT) AS score, hard, CASE WHEN hard IS NOT NULL THEN 'break' WHEN p IS NULL THEN 'uncertain'
  WHEN points >= 3 AND p <= 0.95 AND gap_ms <= 500 THEN 'join'
  WHEN points >= 3 AND p <= 0.95 AND gap_ms <= 1500 AND p < 0.20 THEN 'join'
  WHEN points >= 3 AND p <= 0.95 AND gap_ms > 1500 AND p < 0.05 THEN 'join'
  WHEN points < 3 AND independent THEN 'break'
  WHEN gap_ms > 1500 THEN 'break'
  WHEN p < CASE WHEN gap_ms <= 500 THEN 0.50 ELSE 0.20 END THEN 'join' WHEN p > CASE WHEN gap_ms <= 500 THEN 0.50 ELSE 0.20 END THEN 'break' ELSE 'uncertain' END AS decision
FROM reasoned
"""

GROUPING_ERRORS = f"""
WITH {answers(D)},
given AS (SELECT conv_id, list(id ORDER BY place) AS got FROM answers GROUP BY conv_id),
due AS (SELECT conv_id, list(id ORDER BY pos) AS want FROM turns GROUP BY conv_id)
SELECT conv_id, len(want) AS n_cues, coalesce(len(got), 0) AS n_items, CASE WHEN len(got) > len(list_distinct(got)) THEN 'repeated cue'
  WHEN len(list_filter(got, lambda x: NOT list_contains(want, x))) > 0 THEN 'unknown cue'
  WHEN len(list_filter(want, lambda x: NOT list_contains(coalesce(got, []), x))) > 0 THEN 'missing cue' WHEN got <> want THEN 'cues out of order' END AS error
FROM due LEFT JOIN given USING (conv_id)
"""

MODEL_EVIDENCE = f"""
WITH {entries(D)},
answered AS (SELECT conv_id, count(*) AS received FROM entries GROUP BY conv_id),
scores AS (SELECT conv_id, pos, CASE WHEN json_type(entry) = 'OBJECT' THEN coalesce(json_extract(entry, '$.modelProbability'), json_extract(entry, '$.model_probability'), json_extract(entry, '$.boundaryProbability'),
  json_extract(entry, '$.boundary_probability'), json_extract(entry, '$.probability')) ELSE CAST(entry AS JSON) END AS s FROM entries),
wrong AS (SELECT DISTINCT e.conv_id FROM entries e JOIN due u ON u.conv_id = e.conv_id AND u.pos = e.pos WHERE json_type(e.entry) = 'OBJECT' AND (
  CAST(json_extract_string(e.entry, '$.leftIndex') AS BIGINT) <> u.pos - 1 OR json_extract_string(e.entry, '$.leftSegmentId') <> u.lid OR json_extract_string(e.entry, '$.right_segment_id') <> u.rid)),
told AS (SELECT u.conv_id, u.pos - 1 AS boundary, s, CASE WHEN coalesce(received, 0) <> expected THEN 'wrong number of entries' WHEN u.conv_id IN (SELECT conv_id FROM wrong) THEN 'entries out of order' END AS error
  FROM due u LEFT JOIN answered a ON a.conv_id = u.conv_id LEFT JOIN scores c ON c.conv_id = u.conv_id AND c.pos = u.pos WHERE u.pos < u.n)
SELECT conv_id, boundary, CASE WHEN error IS NULL AND json_type(s) IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND TRY_CAST(s AS DOUBLE) BETWEEN 0 AND 1 THEN TRY_CAST(s AS DOUBLE) END AS p, error FROM told
"""

SIMILARITY_REQUEST_ERRORS = f"""
WITH {asked(D)},
word AS (SELECT doc_id, CASE WHEN word IS NULL OR word = '' THEN 'word: empty' WHEN length(word) > 100 THEN 'word: too long' WHEN NOT regexp_full_match(word, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+([''’-][\\p{{L}}\\p{{Nl}}\\p{{No}}]+)*') THEN 'word: not one word' END AS error FROM asked),
sentence AS (SELECT doc_id, 'one' AS field, one AS t FROM asked UNION ALL SELECT doc_id, 'two', two FROM asked),
faults AS (SELECT doc_id, error FROM word WHERE error IS NOT NULL UNION ALL SELECT doc_id, field || ': empty' FROM sentence WHERE t IS NULL OR t = '' UNION ALL SELECT doc_id, field || ': too long' FROM sentence WHERE length(t) > 5000)
SELECT doc_id, error FROM faults
UNION ALL SELECT s.doc_id, s.field || ': word absent' FROM sentence s JOIN asked a ON a.doc_id = s.doc_id WHERE s.doc_id NOT IN (SELECT doc_id FROM faults)
  AND NOT list_contains(regexp_extract_all(lower(s.t), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+(?:[''’-][\\p{{L}}\\p{{Nl}}\\p{{No}}]+)*'), lower(a.word))
"""

REFERENCE_GAPS = f"""
WITH {cues(D)}
SELECT l.source_id, l.ordinal, c.ordinal AS cue, CASE WHEN c.ordinal < l.ordinal THEN 'previous' WHEN c.ordinal = l.ordinal THEN 'left' WHEN c.ordinal = l.ordinal + 1 THEN 'right' ELSE 'next' END AS side
FROM cues l JOIN cues r ON r.source_id = l.source_id AND r.ordinal = l.ordinal + 1 JOIN cues c ON c.source_id = l.source_id AND c.ordinal BETWEEN l.ordinal - 3 AND l.ordinal + 4
WHERE (c.source_id * 13 + c.ordinal * 7) % 97 = 0
"""

TARGET_CONTEXTS = f"""
WITH {tokens(D)},
o AS (SELECT doc_id, any_value(target) AS target, list(start ORDER BY start) AS s, list(stop ORDER BY start) AS e, list(i ORDER BY start) AS k FROM found GROUP BY doc_id),
b AS (SELECT o.*, p.body, p.toks, length(p.body) AS chars, greatest(0, s[1] - 256) AS lo, least(length(p.body), e[1] + 256) AS hi FROM o JOIN picked p ON p.doc_id = o.doc_id),
m AS (SELECT *, list_filter(range(1, len(s) + 1), lambda j: s[j] >= lo AND e[j] <= hi) AS kept FROM b),
c AS (SELECT *, array_to_string(list_transform(range(lo, hi), lambda x: CASE WHEN len(list_filter(kept, lambda j: s[j] = x)) > 0 THEN '[TARGET]' WHEN len(list_filter(kept, lambda j: s[j] <= x AND x < e[j])) > 0 THEN '' ELSE substr(body, x + 1, 1) END), '') AS hidden,
  if(lo > 0, '... ', '') AS head, if(hi < chars, ' ...', '') AS tail FROM m)
SELECT doc_id, target, head || substr(body, lo + 1, hi - lo) || tail AS context, 'Target word: "' || target || '". Sentence context (target masked): ' || head || hidden || tail AS masked,
  if(k[1] > 0, lower(toks[k[1]]), NULL) AS before, if(len(k) > 1 AND k[2] = k[1] + 1, NULL, lower(toks[k[1] + 2])) AS after,
  if(coalesce(len(k) > 1 AND k[2] > k[1] + 1 AND lower(toks[k[1] + 2]) = 'of' AND lower(toks[k[2] + 2]) = 'of', false), 0.25, 0.0)::DOUBLE AS frame_bonus
FROM c
"""

DATASET_REPORT = f"""
WITH {states(D)},
entries AS (SELECT doc_id, source, lang, (SELECT s.review_status FROM states s WHERE s.boundary_id = 'b' || c.doc_id) AS status, (SELECT s.label_origin FROM states s WHERE s.boundary_id = 'b' || c.doc_id) AS origin FROM documents c),
facts AS (SELECT 'source' AS section, coalesce(source, 'unknown') AS entry, count(*) AS n FROM entries GROUP BY ALL
  UNION ALL SELECT 'lang', coalesce(lang, 'unknown'), count(*) FROM entries GROUP BY ALL UNION ALL SELECT 'split', if(doc_id % 3 = 2, 'test', 'dev') AS e, count(*) FROM entries GROUP BY ALL
  UNION ALL SELECT 'status', coalesce(status, 'unreviewed'), count(*) FROM entries GROUP BY ALL UNION ALL SELECT 'origin', coalesce(origin, 'none'), count(*) FROM entries GROUP BY ALL UNION ALL SELECT 'all', '*', count(*) FROM entries)
SELECT f.section, f.entry, f.n, 1 + (SELECT count(*) FROM facts o WHERE o.section = f.section AND (o.n > f.n OR o.n = f.n AND o.entry < f.entry)) AS place FROM facts f
"""

IMPORT_ERRORS = f"""
WITH {handed_in(D)},
told AS (SELECT h.*, CASE
  WHEN r_queue = '' THEN 'queueId is empty' WHEN r_boundary = '' THEN 'boundaryId is empty' WHEN r_reviewer = '' THEN 'queueReviewer is empty' WHEN r_round = '' THEN 'queueRound is empty' WHEN r_split = '' THEN 'queueSplit is empty'
  WHEN TRY_CAST(r_round AS INT) IS NULL THEN 'queueRound is no number' WHEN r_queue <> queue_id THEN 'queueId of another queue' WHEN r_reviewer <> 'ana' THEN 'another reviewer' WHEN r_round::INT <> 1 THEN 'another round'
  WHEN r_split <> 'dev' THEN 'another split' WHEN r_boundary <> built THEN 'boundaryId is not that of source and cues'
  WHEN built NOT IN (SELECT boundary_id FROM batches) THEN 'not a candidate' WHEN NOT EXISTS (SELECT 1 FROM manifest m WHERE m.queue_id = h.queue_id AND m.boundary_id = h.built) THEN 'not in this queue' END AS a FROM handed h),
seen AS (SELECT t.*, CASE WHEN a IS NULL AND EXISTS (SELECT 1 FROM told o WHERE o.queue_id = t.queue_id AND o.built = t.built AND o.a IS NULL AND o.line < t.line) THEN 'duplicate boundaryId'
  WHEN a IS NULL AND trim(r_text) <> '' AND NOT EXISTS (SELECT 1 FROM batches b WHERE b.boundary_id = t.built AND (trim(t.r_text) = b.text OR trim(t.r_text, '"') = trim(b.text, '"'))) THEN 'text modified' ELSE a END AS b FROM told t),
filled AS (SELECT *, CASE WHEN label = '' THEN 'missing label' WHEN label = 'MAYBE' THEN 'invalid label' WHEN confidence = '' THEN 'missing confidence' WHEN confidence = 'sure' THEN 'invalid confidence' WHEN reason = '' THEN 'missing reason' END AS c FROM seen),
found AS (SELECT queue_id, line, coalesce(b, c) AS error FROM filled f WHERE b IS NOT NULL OR (c IS NOT NULL AND NOT EXISTS (SELECT 1 FROM filled o WHERE o.queue_id = f.queue_id AND o.line < f.line AND (o.b IS NOT NULL OR o.c IS NOT NULL))))
SELECT queue_id, CAST(line AS BIGINT) AS line, error FROM found
UNION ALL SELECT queue_id, 0, 'order is not the manifest''s' FROM (SELECT queue_id, list(built ORDER BY line) AS got FROM handed GROUP BY queue_id) g
  JOIN (SELECT queue_id, list(boundary_id ORDER BY rn) AS want FROM manifest GROUP BY queue_id) w USING (queue_id) WHERE got <> want AND queue_id NOT IN (SELECT queue_id FROM found)
"""

QUEUE_MANIFEST_ERRORS = f"""
WITH {manifests(D)}
SELECT queue_id, 'missing or empty queueId' AS error FROM manifests WHERE q = ''
UNION ALL SELECT queue_id, 'missing reviewerId' FROM manifests WHERE reviewer = ''
UNION ALL SELECT queue_id, 'invalid reviewRound' FROM manifests WHERE coalesce(round, 0) NOT BETWEEN 1 AND 2
UNION ALL SELECT queue_id, 'invalid split' FROM manifests WHERE split NOT IN ('dev', 'test')
UNION ALL SELECT queue_id, 'missing or empty boundaryIds' FROM manifests WHERE n = 0
UNION ALL SELECT queue_id, 'duplicate boundaryId' FROM manifests WHERE kinds < n
UNION ALL SELECT queue_id, 'rowCount is not the number of ids' FROM manifests WHERE n <> row_count
UNION ALL SELECT queue_id, CASE WHEN sha = '' THEN 'missing or empty contentSha256' WHEN length(sha) = 64 THEN 'contentSha256 is not lowercase hexadecimal' ELSE 'contentSha256 is not 64 characters' END FROM manifests WHERE NOT regexp_full_match(sha, '[0-9a-f]{{64}}')
"""

READINESS = f"""
WITH {states(D)}, {SPOILT.replace('entries AS', 'spoilt AS', 1)}, {sources(D)}, {candidates(D)}, {lacking(D)},
bad_origins AS (SELECT boundary_id FROM spoilt WHERE (gold_label IS NOT NULL AND origin IS DISTINCT FROM 'human') OR (status = 'unreviewed' AND origin IS NOT NULL) OR (status IN ('reviewed', 'adjudicated') AND origin IS DISTINCT FROM 'human')
  OR (status = 'needs_adjudication' AND gold_label IS NOT NULL) OR gold_label NOT IN ('JOIN', 'BREAK', 'AMBIGUOUS') OR status NOT IN ('unreviewed', 'reviewed', 'needs_adjudication', 'adjudicated')),
langs AS (SELECT DISTINCT lang FROM entries),
gates AS (SELECT g.lang,
  (SELECT count(*) FROM entries e WHERE e.lang = g.lang) >= 150 AS enough_entries,
  (SELECT count(DISTINCT source_id) FROM entries e WHERE e.lang = g.lang) >= 2 AS enough_sources,
  EXISTS (SELECT 1 FROM entries e WHERE e.lang = g.lang AND break_like) AND EXISTS (SELECT 1 FROM entries e WHERE e.lang = g.lang AND join_like) AS both_kinds,
  (SELECT count(DISTINCT timing_band) FROM entries e WHERE e.lang = g.lang) >= 2 AS enough_bands,
  EXISTS (SELECT 1 FROM entries e WHERE e.lang = g.lang AND inverted) OR EXISTS (SELECT 1 FROM entries e JOIN manifest m ON m.source_id = e.source_id WHERE e.lang = g.lang AND m.structure = 'dialogue') AS speech,
  NOT EXISTS (SELECT 1 FROM entries e WHERE e.lang = g.lang AND e.source_id NOT IN (SELECT source_id FROM manifest)) AS known_sources,
  NOT EXISTS (SELECT 1 FROM manifest m WHERE coalesce(m.lang, 'none') = g.lang AND title IS NULL) AS full_provenance,
  NOT EXISTS (SELECT 1 FROM manifest m WHERE coalesce(m.lang, 'none') = g.lang AND tier = 'bought') AS valid_tiers,
  NOT EXISTS (SELECT 1 FROM lacking l WHERE coalesce(l.lang, 'none') = g.lang AND l.source_id IN (SELECT source_id FROM entries)) AS reference_complete, true AS no_model_fields,
  NOT EXISTS (SELECT 1 FROM documents c JOIN bad_origins b ON b.boundary_id = 'b' || c.doc_id WHERE coalesce(c.lang, 'none') = g.lang) AS origins_agree FROM langs g)
SELECT *, enough_entries AND enough_sources AND both_kinds AND enough_bands AND speech AND known_sources AND full_provenance AND valid_tiers AND reference_complete AND origins_agree AS ready FROM gates
"""

PROVENANCE = f"""
WITH {sources(D)}, {cues(D)}
SELECT m.source_id, content_type, structure, coalesce(lang, 'unknown') AS lang, tier, greatest(0, (SELECT count(*) FROM cues c WHERE c.source_id = m.source_id) - 1) AS candidates FROM manifest m
"""

SILVER_LABELS = f"""
WITH {passes(D)},
told AS (SELECT doc_id, rebuilt, CASE WHEN len(list_distinct([one, two, verifier])) > 1 OR verifier_sure = 'low' THEN 'AMBIGUOUS' WHEN one <> 'JOIN' THEN one
  WHEN 'low' IN (one_sure, two_sure) OR coalesce(rebuilt, '') = '' OR speakers_change OR question_answer OR caption_merge THEN 'AMBIGUOUS' ELSE 'JOIN' END AS label FROM passes)
SELECT doc_id, label, if(label = 'JOIN', rebuilt, NULL) AS rebuilt FROM told
"""

HAND_WRITTEN: dict[str, str] = {
    "ledger_errors": LEDGER_ERRORS,
    "review_state": REVIEW_STATE,
    "label_origin_errors": LABEL_ORIGIN_ERRORS,
    "round1_queue": ROUND1_QUEUE,
    "round2_queue": ROUND2_QUEUE,
    "sentence_cue_overlap": CUE_OVERLAP,
    "dialogue_decisions": DIALOGUE,
    "grouping_errors": GROUPING_ERRORS,
    "model_evidence": MODEL_EVIDENCE,
    "similarity_request_errors": SIMILARITY_REQUEST_ERRORS,
    "reference_gaps": REFERENCE_GAPS,
    "target_contexts": TARGET_CONTEXTS,
    "dataset_report": DATASET_REPORT,
    "import_errors": IMPORT_ERRORS,
    "operational_readiness": READINESS,
    "source_provenance": PROVENANCE,
    "silver_labels": SILVER_LABELS,
    "queue_manifest_errors": QUEUE_MANIFEST_ERRORS,
}
