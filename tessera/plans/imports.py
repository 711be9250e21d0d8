"""Plans that check what reviewers hand in: rows of a filled-in queue against its manifest and the candidates, and manifests."""

from __future__ import annotations

from ..functions.dialect import Spark

SIZE = 25

#: Rules of a row by itself and beside what it is joined to; the first that is broken is the row's error.
ROW_RULES = (
    ("queueId is empty", "r_queue = ''"),
    ("boundaryId is empty", "r_boundary = ''"),
    ("queueReviewer is empty", "r_reviewer = ''"),
    ("queueRound is empty", "r_round = ''"),
    ("queueSplit is empty", "r_split = ''"),
    ("queueRound is no number", "NOT r_round RLIKE '^[+-]?[0-9]+$'"),
    ("queueId of another queue", "r_queue <> queue_id"),
    ("another reviewer", "r_reviewer <> 'ana'"),
    ("another round", "try_cast(r_round AS INT) <> 1"),
    ("another split", "r_split <> 'dev'"),
    ("boundaryId is not that of source and cues", "r_boundary <> built"),
    ("not a candidate", "text IS NULL"),
    ("not in this queue", "listed IS NULL"),
)
#: Rules of what the reviewer fills in.
LABEL_RULES = (
    ("missing label", "label = ''"),
    ("invalid label", "label NOT IN ('JOIN', 'BREAK', 'AMBIGUOUS')"),
    ("missing confidence", "confidence = ''"),
    ("invalid confidence", "confidence NOT IN ('high', 'medium', 'low')"),
    ("missing reason", "reason = ''"),
)


def batches(d: Spark) -> str:
    """Candidates of a source in batches of 25; x says how a row is spoilt, if it is."""
    kind = d.mod("doc_id * 7", "61")
    return (
        f"batches AS (SELECT *, concat(coalesce(source, 'none'), '-', CAST(batch AS VARCHAR(12))) AS queue_id, concat('b', CAST(doc_id AS VARCHAR(20))) AS boundary_id,"
        f" CASE WHEN batch % 3 = 1 THEN {kind} WHEN batch % 3 = 2 AND {kind} > 14 THEN {kind} ELSE 0 END AS x FROM (SELECT doc_id, source, text, rn, {d.div('rn - 1', str(SIZE))} AS batch"
        f" FROM (SELECT doc_id, source, substr(coalesce(text, ''), 1, 80) AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) a) b)"
    )


def handed_in(d: Spark) -> str:
    """Rows of filled-in queues, line by line: some batches are sound, some turned round, some hold rows of every fault."""
    spoil = lambda column, *cases: f"CASE x {' '.join(f'WHEN {x} THEN {v!r}' for x, v in cases)} ELSE {column} END"
    line = "CASE WHEN batch % 3 = 0 AND length(source) > 4 THEN -rn ELSE rn END * 2"
    return (
        f"{batches(d)}, given AS (SELECT queue_id, {line} AS line, {spoil('queue_id', (1, ''), (2, 'other'))} AS r_queue, {spoil('boundary_id', (3, ''), (4, 'zz'), (12, 'b-1'))} AS r_boundary,"
        f" {spoil(repr('ana'), (5, ''), (6, 'ben'))} AS r_reviewer, {spoil(repr('1'), (7, ''), (8, 'two'), (9, '2'))} AS r_round, {spoil(repr('dev'), (10, ''), (11, 'test'))} AS r_split,"
        f" {spoil('boundary_id', (12, 'b-1'))} AS built, CASE WHEN x = 15 THEN concat(text, '!') WHEN x = 16 THEN '' ELSE text END AS r_text, {spoil(repr('JOIN'), (20, ''), (21, 'MAYBE'))} AS label,"
        f" {spoil(repr('low'), (22, ''), (23, 'sure'))} AS confidence, {spoil(repr('why'), (24, ''))} AS reason, x FROM batches),"
        f" handed AS (SELECT * FROM given UNION ALL SELECT queue_id, line + 1, r_queue, r_boundary, r_reviewer, r_round, r_split, built, r_text, label, confidence, reason, x FROM given WHERE x = 14),"
        f" manifest AS (SELECT queue_id, boundary_id, rn FROM batches WHERE x <> 13)"
    )


def import_errors(d: Spark) -> str:
    """A row for each refused line with its first broken rule; what the reviewer filled in is told for the first wrong line alone.

    A queue without wrong lines whose boundaries are not the manifest's in its order has one row with line 0.
    """
    first = lambda rules: "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in rules)
    in_order = lambda x, order: d.listagg(x, ",", order)
    return (
        f"WITH {handed_in(d)}, joined AS (SELECT h.*, b.text, m.rn AS listed FROM handed h LEFT JOIN batches b ON b.boundary_id = h.built LEFT JOIN manifest m ON m.queue_id = h.queue_id AND m.boundary_id = h.built),"
        f" placed AS (SELECT *, {first(ROW_RULES)} END AS fault FROM joined), nth AS (SELECT *, row_number() OVER (PARTITION BY queue_id, built, fault IS NULL ORDER BY line) AS nth FROM placed),"
        f" judged AS (SELECT *, coalesce(fault, CASE WHEN nth > 1 THEN 'duplicate boundaryId' WHEN trim(r_text) <> '' AND trim(r_text) <> text AND trim(BOTH '\"' FROM r_text) <> trim(BOTH '\"' FROM text) THEN 'text modified' END) AS broken, {first(LABEL_RULES)} END AS unfilled FROM nth),"
        f" wrong AS (SELECT *, min(CASE WHEN broken IS NOT NULL OR unfilled IS NOT NULL THEN line END) OVER (PARTITION BY queue_id) AS first_wrong FROM judged),"
        f" due AS (SELECT queue_id, {in_order('boundary_id', 'rn')} AS ids FROM manifest GROUP BY queue_id), sound AS (SELECT queue_id, {in_order('built', 'line')} AS ids FROM wrong WHERE first_wrong IS NULL GROUP BY queue_id)"
        f" SELECT queue_id, CAST(line AS BIGINT) AS line, coalesce(broken, unfilled) AS error FROM wrong WHERE broken IS NOT NULL OR (unfilled IS NOT NULL AND line = first_wrong)"
        f" UNION ALL SELECT s.queue_id, CAST(0 AS BIGINT), 'order is not the manifest''s' FROM sound s JOIN due u ON u.queue_id = s.queue_id WHERE s.ids <> u.ids"
    )


#: Rules of a manifest; each that is broken is an error.
MANIFEST_RULES = (
    ("missing or empty queueId", "q = ''"),
    ("missing reviewerId", "reviewer = ''"),
    ("invalid reviewRound", "round IS NULL OR round NOT IN (1, 2)"),
    ("invalid split", "split NOT IN ('dev', 'test')"),
    ("missing or empty boundaryIds", "n = 0"),
    ("duplicate boundaryId", "n > kinds"),
    ("rowCount is not the number of ids", "row_count <> n"),
    ("missing or empty contentSha256", "sha = ''"),
    ("contentSha256 is not 64 characters", "sha <> '' AND length(sha) <> 64"),
    ("contentSha256 is not lowercase hexadecimal", "length(sha) = 64 AND NOT sha RLIKE '^[0-9a-f]*$'"),
)


def manifests(d: Spark) -> str:
    """Manifests of the batches, one in two with a fault."""
    x = d.mod("total", "22")
    return (
        f"{batches(d)}, listed AS (SELECT queue_id, boundary_id, doc_id FROM batches UNION ALL SELECT queue_id, boundary_id, doc_id FROM batches WHERE x = 14),"
        f" grouped AS (SELECT queue_id, CAST(sum(doc_id) AS BIGINT) AS total, count(*) AS n, count(DISTINCT boundary_id) AS kinds, {d.sha256('queue_id')} AS sha FROM listed GROUP BY queue_id),"
        f" coded AS (SELECT *, {x} AS x FROM grouped),"
        f" manifests AS (SELECT queue_id, CASE WHEN x = 1 THEN '' ELSE queue_id END AS q, CASE WHEN x = 2 THEN '' ELSE 'ana' END AS reviewer, CASE WHEN x = 3 THEN NULL WHEN x = 4 THEN 3 ELSE 1 END AS round,"
        f" CASE WHEN x = 5 THEN 'train' ELSE 'dev' END AS split, CASE WHEN x = 6 THEN 0 ELSE n END AS n, CASE WHEN x = 6 THEN 0 ELSE kinds END AS kinds, CASE WHEN x = 7 THEN n + 1 WHEN x = 6 THEN 0 ELSE n END AS row_count,"
        f" CASE WHEN x = 8 THEN '' WHEN x = 9 THEN substr(sha, 1, 60) WHEN x = 10 THEN concat('X', substr(sha, 2)) ELSE sha END AS sha FROM coded)"
    )


def queue_manifest_errors(d: Spark) -> str:
    flags = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in MANIFEST_RULES)
    return f"WITH {manifests(d)} SELECT queue_id, explode(array_compact(array({flags}))) AS error FROM manifests"


PLANS = (import_errors, queue_manifest_errors)
