"""Plans over whole sets of candidates: whether they may be used, where they come from, and labels that several passes agree on."""

from __future__ import annotations

from ..functions import text as T
from ..functions.dialect import Spark
from .cues import boundaries, timing_band
from .labelling import ORIGIN_RULES, SPOILT, pick, states

# What a manifest and a candidate may say.
TIERS = ("native_original", "professional_translation", "community_translation", "reviewed_machine_transcription", "unknown")
MODEL_FIELDS = ("modelProbability", "modelPrediction", "modelScore", "saTScore", "prediction", "model", "evidence")
#: Columns of the candidates below; none of them may be one that a model fills in.
FIELDS = ("source_id", "lang", "timing_band", "break_like", "join_like", "inverted")


def sources(d: Spark) -> str:
    """A manifest with a row for each document but some; titles and tiers are missing or unknown here and there."""
    return (
        f"manifest AS (SELECT doc_id AS source_id, lang, source, CASE WHEN doc_id % 199 = 3 THEN NULL ELSE concat('t', CAST(doc_id AS VARCHAR(20))) END AS title, {pick(d, 'doc_id * 3', ('film', 'series', 'talk'))} AS content_type,"
        f" {pick(d, 'doc_id * 5', ('dialogue', 'monologue', 'unknown'))} AS structure, CASE WHEN doc_id % 211 = 7 THEN 'bought' ELSE {pick(d, 'doc_id * 7', TIERS)} END AS tier FROM documents WHERE doc_id % 307 <> 5)"
    )


def entries(d: Spark) -> str:
    """Adjacent cues with what the gates ask of them."""
    return (
        f"{boundaries(d)}, plain AS (SELECT source_id, lang, gap_ms, lcue, rcue, {T.normalised(d, 'lcue')} AS lv, {T.normalised(d, 'rcue')} AS rv FROM boundaries),"
        f" entries AS (SELECT source_id, coalesce(lang, 'none') AS lang, {timing_band('gap_ms')} AS timing_band, ({d.match('rv', r'^\p{Lu}')} AND {d.match('lv', T.STRONG_END)}) OR {T.short_response(d, 'rv')} OR {d.match('rcue', T.DASH)} AS break_like,"
        f" {d.match('rv', r'^\p{Ll}')} OR {T.misleading_period(d, 'lv', 'rv')} AS join_like, {d.match('rv', '^[¿¡]')} AS inverted FROM plain)"
    )


def lacking(d: Spark) -> str:
    """Cues that the reference cues lack; cues of a source with two or more are named by a candidate, as left or right."""
    return f"lacking AS (SELECT source_id, lang FROM cues WHERE {d.mod('source_id * 13 + ordinal * 7', '997')} = 0)"


def operational_readiness(d: Spark) -> str:
    """The gates of each language, and whether all are open: enough entries, sources, tags, bands, dialogue; manifest, reference cues and label origins in order."""
    wrong = " OR ".join(f"({c})" for _, c in ORIGIN_RULES)
    any_of = lambda c: f"max(CASE WHEN {c} THEN 1 ELSE 0 END) = 1"
    none_of = lambda c: f"max(CASE WHEN {c} THEN 1 ELSE 0 END) = 0"
    gates = (
        "enough_entries", "enough_sources", "both_kinds", "enough_bands", "speech", "known_sources", "full_provenance", "valid_tiers", "reference_complete", "no_model_fields", "origins_agree",
    )
    free = str(not set(FIELDS) & set(MODEL_FIELDS)).lower()
    return (
        f"WITH {states(d)}, {SPOILT.replace('entries AS', 'spoilt AS', 1)}, {sources(d)}, {entries(d)}, {lacking(d)},"
        f" told AS (SELECT e.lang, count(*) >= 150 AS enough_entries, count(DISTINCT e.source_id) >= 2 AS enough_sources, {any_of('break_like')} AND {any_of('join_like')} AS both_kinds, count(DISTINCT timing_band) >= 2 AS enough_bands,"
        f" {any_of('m.structure = ' + repr('dialogue') + ' OR inverted')} AS speech, {none_of('m.source_id IS NULL')} AS known_sources FROM entries e LEFT JOIN manifest m ON m.source_id = e.source_id GROUP BY e.lang),"
        f" registered AS (SELECT coalesce(lang, 'none') AS lang, {none_of('title IS NULL')} AS full_provenance, {none_of('tier NOT IN (' + ', '.join(map(repr, TIERS)) + ')')} AS valid_tiers FROM manifest GROUP BY coalesce(lang, 'none')),"
        f" gone AS (SELECT DISTINCT coalesce(l.lang, 'none') AS lang FROM lacking l JOIN (SELECT DISTINCT source_id FROM entries) e ON e.source_id = l.source_id),"
        f" disputed AS (SELECT DISTINCT coalesce(c.lang, 'none') AS lang FROM spoilt s JOIN documents c ON concat('b', CAST(c.doc_id AS VARCHAR(20))) = s.boundary_id WHERE {wrong}),"
        f" gated AS (SELECT t.*, coalesce(r.full_provenance, true) AS full_provenance, coalesce(r.valid_tiers, true) AS valid_tiers, g.lang IS NULL AS reference_complete, {free} AS no_model_fields, p.lang IS NULL AS origins_agree"
        f" FROM told t LEFT JOIN registered r ON r.lang = t.lang LEFT JOIN gone g ON g.lang = t.lang LEFT JOIN disputed p ON p.lang = t.lang)"
        f" SELECT lang, {', '.join(gates)}, {' AND '.join(gates)} AS ready FROM gated"
    )


def source_provenance(d: Spark) -> str:
    """Every source of the manifest with what is known of it and how many candidates it gave, none included."""
    return (
        f"WITH {sources(d)}, {boundaries(d)}, counts AS (SELECT source_id, count(*) AS n FROM boundaries GROUP BY source_id)"
        f" SELECT m.source_id, content_type, structure, coalesce(lang, 'unknown') AS lang, tier, coalesce(n, 0) AS candidates FROM manifest m LEFT JOIN counts c ON c.source_id = m.source_id"
    )


def passes(d: Spark) -> str:
    """Labels and confidences of two first passes and a verifier for each labelled document."""
    label = lambda k: pick(d, f"doc_id * {k} + quality", ("JOIN", "BREAK", "JOIN", "AMBIGUOUS", "JOIN"))
    sure = lambda k: pick(d, f"doc_id * {k} + toxic", ("high", "medium", "low", "high"))
    return (
        f"passes AS (SELECT doc_id, {label(2)} AS one, {label(3)} AS two, {label(4)} AS verifier, {sure(3)} AS one_sure, {sure(5)} AS two_sure, {sure(7)} AS verifier_sure,"
        f" CASE WHEN doc_id % 11 <> 4 THEN concat('s', CAST(doc_id AS VARCHAR(20))) END AS rebuilt, doc_id % 13 = 5 AS speakers_change, doc_id % 17 = 6 AS question_answer, doc_id % 19 = 7 AS caption_merge FROM labels)"
    )


def silver_labels(d: Spark) -> str:
    """The label that passes agree on. A join needs both first passes, none of low confidence, a sure verifier, a rebuilt sentence and one speaker's words; any other agreement but on BREAK is AMBIGUOUS."""
    join = (
        "one = 'JOIN' AND two = 'JOIN' AND verifier = 'JOIN' AND one_sure <> 'low' AND two_sure <> 'low' AND verifier_sure IN ('high', 'medium') AND trim(coalesce(rebuilt, '')) <> ''"
        " AND NOT speakers_change AND NOT question_answer AND NOT caption_merge"
    )
    agreed = f"CASE WHEN one <> two OR verifier <> one OR verifier_sure = 'low' THEN 'AMBIGUOUS' WHEN {join} THEN 'JOIN' WHEN one = 'BREAK' THEN 'BREAK' ELSE 'AMBIGUOUS' END"
    return f"WITH {passes(d)}, agreed AS (SELECT doc_id, rebuilt, {agreed} AS label FROM passes) SELECT doc_id, label, CASE WHEN label = 'JOIN' THEN rebuilt END AS rebuilt FROM agreed"


PLANS = (operational_readiness, source_provenance, silver_labels)
