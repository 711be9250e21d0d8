"""Plans over cues, boundaries, decisions and sentences, as chains of named sub-queries."""

from __future__ import annotations

from ..functions import text as T
from ..functions.dialect import Spark
from .policy import DEFAULT, Policy

#: Gaps that the fixture deals out: every band and both sides of every limit.
GAPS = (120, 500, 501, 1500, 1501, 4999, 5000, 29999, 30000, 30001, -40, 250, 80, 310, 95)
STEP_MS = 32_000


def cues(d: Spark) -> str:
    """Six-word pieces of the documents' lines: source_id, lang, ordinal, cue, start_ms, end_ms."""
    lines = d.filter(d.split("text", r"\n"), "l", "trim(l) <> ''")
    words = d.transform(lines, "l", d.split("trim(l)", "[ ]+"))  # split once a line, then cut
    pieces = d.transform(d.upto(f"{d.div(f'{d.size(chr(119))} - 1', '6')} + 1"), "i", d.join(d.slice("w", "i * 6 + 1", "6"), " "))
    nested = d.transform(words, "w", pieces)
    gap = d.item(d.array(*map(str, GAPS)), f"1 + {d.mod('source_id * 7 + ordinal * 13', str(len(GAPS)))}")
    inner = d.unnest("c", "source_id, lang", f"(SELECT doc_id AS source_id, lang, flatten({nested}) AS c FROM documents)", "ordinal", "cue")
    return (
        f"cues AS (SELECT *, CAST(start_ms + {STEP_MS} - gap AS BIGINT) AS end_ms FROM (SELECT source_id, lang, ordinal, cue, CAST(ordinal * {STEP_MS} AS BIGINT) AS start_ms,"
        f" CAST({gap} AS BIGINT) AS gap FROM ({inner}) a) b)"
    )


def english(lang: str) -> str:
    """Whether a language tag asks for the English profile: none, an empty one, or any kind of English."""
    return f"(coalesce({lang}, '') = '' OR lower(trim({lang})) = 'en' OR lower(trim({lang})) LIKE 'en-%' OR lower(trim({lang})) LIKE 'en!_%' ESCAPE '!')"


def band(gap: str, c: Policy = DEFAULT) -> str:
    return f"CASE WHEN {gap} <= {c.normal_gap_ms} THEN 'normal' WHEN {gap} <= {c.medium_gap_ms} THEN 'medium' WHEN {gap} < {c.extreme_gap_ms} THEN 'large' ELSE 'extreme' END"


def timing_band(gap: str) -> str:
    """Negative gaps fall through to the last band, as the rule defines it."""
    return (
        f"CASE WHEN {gap} BETWEEN 0 AND 100 THEN '0-100ms' WHEN {gap} BETWEEN 101 AND 300 THEN '101-300ms' WHEN {gap} BETWEEN 301 AND 500 THEN '301-500ms'"
        f" WHEN {gap} BETWEEN 501 AND 1500 THEN '501-1500ms' WHEN {gap} BETWEEN 1501 AND 3000 THEN '1501-3000ms' ELSE '3000+ms' END"
    )


def boundaries(d: Spark) -> str:
    """Adjacent cues of a source by lead(): never a self-join. p is the surrogate model probability."""
    lead = "OVER (PARTITION BY source_id ORDER BY ordinal)"
    raw = d.mod("source_id * 31 + ordinal * 17", "103")
    return (
        f"{cues(d)}, boundaries AS (SELECT source_id, lang, ordinal, lcue, rcue, CAST(next_start - end_ms AS BIGINT) AS gap_ms, start_ms, end_ms, next_start,"
        f" CASE WHEN {raw} <= 100 THEN {raw} / 100.0 END AS p FROM (SELECT source_id, lang, ordinal, cue AS lcue, start_ms, end_ms, lead(cue) {lead} AS rcue,"
        f" lead(start_ms) {lead} AS next_start FROM cues) a WHERE rcue IS NOT NULL)"
    )


def signals(d: Spark) -> str:
    """Boundaries with both sides' visible text and words, and the English signals (0 and false elsewhere)."""
    return f"{boundaries(d)}, {signals_of(d, 'boundaries')}"


def signals_of(d: Spark, rows: str) -> str:
    """Signals of any rows with lang, lcue and rcue."""
    e = T.English(d)
    return (
        f"sides AS (SELECT *, {d.extract_all('lv', T.ENGLISH_WORD)} AS lw, {d.extract_all('rv', T.ENGLISH_WORD)} AS rw FROM"
        f" (SELECT *, {T.visible(d, 'lcue')} AS lv, {T.visible(d, 'rcue')} AS rv FROM {rows}) a),"
        f" scored AS (SELECT *, CASE WHEN {english('lang')} THEN {e.score()} ELSE CAST(0 AS BIGINT) END AS score, CASE WHEN {english('lang')} THEN {e.join_issue('lcue', 'rcue')} END AS issue FROM sides),"
        f" signals AS (SELECT *, ({english('lang')} AND {e.independent('score')}) AS independent FROM scored)"
    )


def threshold(kind: int) -> str:
    """Profile limits: kind 0 joins below, kind 1 breaks above."""
    limits = {"normal": (0.50, 0.50), "medium": (0.20, 0.20), "other": (0.05, 0.05)}
    neutral = {"normal": (0.40, 0.60), "medium": (0.15, 0.30), "other": (0.03, 0.10)}

    def of(t: dict) -> str:
        return f"CASE band WHEN 'normal' THEN {t['normal'][kind]} WHEN 'medium' THEN {t['medium'][kind]} ELSE {t['other'][kind]} END"

    return f"CASE WHEN {english('lang')} THEN {of(limits)} ELSE {of(neutral)} END"


def soft_rules(c: Policy = DEFAULT) -> tuple[tuple[str, str, str], ...]:
    """Condition, decision and reason (an expression) of the soft rules for a known p, in order; the last one has no condition."""
    config = f"CASE band WHEN 'normal' THEN {c.normal_join_max} WHEN 'medium' THEN {c.medium_join_max} ELSE {c.large_join_max} END"
    gap = "CAST(gap_ms AS VARCHAR(20)), 'ms')"
    return (
        (f"score >= {c.min_score} AND p <= {c.override_max} AND (band = 'normal' OR p < {config})", "join", "concat('continuation outweighs punctuation and model, score ', CAST(score AS VARCHAR(20)))"),
        (f"independent AND score < {c.min_score}", "break", "'independently complete statements'"),
        ("band = 'large'", "break", f"concat('large cue gap ', {gap}"),
        ("band = 'extreme'", "break", f"concat('extreme cue gap ', {gap}"),
        (f"p < {threshold(0)}", "join", "'model favors continuation'"),
        (f"p > {threshold(1)}", "break", "'model favors a sentence boundary'"),
        ("", "uncertain", "'model is in its uncertainty interval'"),
    )


def soft(c: Policy = DEFAULT) -> str:
    """The soft rules for a known p: the first match wins."""
    *rules, last = soft_rules(c)
    return "CASE " + " ".join(f"WHEN {when} THEN '{what}'" for when, what, _ in rules) + f" ELSE '{last[1]}' END"


def soft_reason(c: Policy = DEFAULT) -> str:
    *rules, last = soft_rules(c)
    return "CASE " + " ".join(f"WHEN {when} THEN {why}" for when, _, why in rules) + f" ELSE {last[2]} END"


def gap_reason(c: Policy = DEFAULT) -> str:
    return f"WHEN gap_ms > {c.extreme_gap_ms} THEN concat('cue gap ', CAST(gap_ms AS VARCHAR(20)), 'ms exceeds extreme-gap threshold {c.extreme_gap_ms}ms')"


TEXT_REASON = "WHEN issue IS NOT NULL THEN concat('joining would corrupt text: ', issue)"


def decisions(d: Spark) -> str:
    """The policy over cues without speakers: hard reasons first, then the soft rules."""
    hard = f"CASE WHEN next_start < start_ms THEN 'cue order is invalid' {gap_reason()} {TEXT_REASON} END"
    return (
        f"{signals(d)}, judged AS (SELECT *, {hard} AS hard FROM (SELECT *, {band('gap_ms')} AS band FROM signals) a),"
        f" decisions AS (SELECT *, CASE WHEN hard IS NOT NULL THEN 'break' WHEN p IS NULL THEN 'uncertain' ELSE {soft()} END AS decision FROM judged)"
    )


def sentences(d: Spark) -> str:
    """Cues with the number of their sentence: a running count of the boundaries that don't join.

    The last cue of a source is a boundary without a right side, so every cue is a row of the decisions and
    its own left boundary is the row before: one scan, one shuffle, no join.
    """
    w = "OVER (PARTITION BY source_id ORDER BY ordinal)"
    said = f"({english('lang')})"
    return (
        f"{decisions(d).replace('a WHERE rcue IS NOT NULL', 'a')}, numbered AS (SELECT *, CAST(sum(CASE WHEN joins THEN 0 ELSE 1 END) {w} AS BIGINT) AS sentence_id FROM"
        f" (SELECT source_id, lang, ordinal, lcue AS cue, start_ms, end_ms, lag(lcue) {w} AS before, coalesce(lag(decision) {w} = 'join', false) AS joins FROM decisions) a),"
        f" parts AS (SELECT *, CASE WHEN NOT joins THEN '' WHEN {T.attaches(d, 'before', 'cue', said)} THEN '' ELSE ' ' END AS sep FROM numbered),"
        f" sentences AS (SELECT source_id, sentence_id, min(start_ms) AS start_ms, {d.greatest_by('end_ms', 'ordinal')} AS end_ms, count(*) AS n_cues, min(ordinal) AS first_ordinal,"
        f" {d.listagg('concat(sep, cue)', '', 'ordinal')} AS sentence FROM parts GROUP BY source_id, sentence_id)"
    )


#: Where proposed sentences end: after every 25th letter e, for want of a model; so they end inside of cues.
PROPOSED = r"(?:[^e]*e){25}|.+$"


def proposed(d: Spark) -> str:
    """Cue spans in the text of a source (cues joined by a space), and the trimmed spans of its proposed sentences."""
    w = "OVER (PARTITION BY source_id ORDER BY ordinal)"
    pieces = d.unnest("pieces", "source_id", "whole", "s", "piece")
    return (
        f"spans AS (SELECT source_id, ordinal, CAST(sum(length(cue) + 1) {w} - length(cue) - 1 AS BIGINT) AS start, CAST(sum(length(cue) + 1) {w} - 1 AS BIGINT) AS stop FROM cues),"
        f" whole AS (SELECT source_id, {d.extract_all(d.listagg('cue', ' ', 'ordinal'), PROPOSED)} AS pieces FROM cues GROUP BY source_id),"
        f" placed AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY source_id ORDER BY s) AS BIGINT) AS ends FROM ({pieces}) a),"
        f" sentences AS (SELECT source_id, s, ends - length(piece) + length(piece) - length(ltrim(piece)) AS start, ends - length(piece) + length(rtrim(piece)) AS stop FROM placed WHERE trim(piece) <> '')"
    )


def scenes_of(d: Spark) -> str:
    """Scenes of a source: a new one after a gap of five seconds or 200 cues."""
    w = "OVER (PARTITION BY source_id ORDER BY ordinal)"
    return (
        f"{cues(d)}, gapped AS (SELECT source_id, ordinal, start_ms, end_ms, CASE WHEN start_ms - lag(end_ms) {w} >= 5000 THEN 1 ELSE 0 END AS cut FROM cues),"
        f" grouped AS (SELECT *, sum(cut) {w} AS g FROM gapped), ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, g ORDER BY ordinal) AS r FROM grouped),"
        f" placed AS (SELECT source_id, ordinal, start_ms, end_ms, dense_rank() OVER (PARTITION BY source_id ORDER BY g, {d.div('r - 1', '200')}) AS scene FROM ranked),"
        f" scenes AS (SELECT source_id, CAST(scene AS BIGINT) AS scene, min(ordinal) AS first_cue, count(*) AS n_cues, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM placed GROUP BY source_id, scene)"
    )
