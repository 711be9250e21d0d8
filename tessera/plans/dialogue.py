"""The policy over cues that carry speakers: names, dashes, several speakers in a cue, numbered ids."""

from __future__ import annotations

from ..functions import text as T
from ..functions.dialect import Spark
from .cues import TEXT_REASON, band, gap_reason, signals_of, soft
from .policy import DEFAULT, Policy


def spoken(d: Spark) -> str:
    """Turns of conversations as cues of one or two lines: labels, brackets, voice tags, dashes or nothing before them."""
    name = "concat(upper(substr(role, 1, 1)), lower(substr(role, 2)))"
    line = (
        "CASE turn % 9 WHEN 0 THEN concat(upper(role), ': ', text) WHEN 1 THEN concat('- ', text) WHEN 2 THEN concat('[', " + name + ", '] ', text)"
        " WHEN 3 THEN concat('<v ', " + name + ", '>', text) WHEN 4 THEN concat('- ', text, '~- and more of it') WHEN 6 THEN concat('USER: ', text, '~ASSISTANT: yes')"
        " WHEN 7 THEN concat(upper(role), ': ', text, '~- no') ELSE text END"
    )
    lines = d.split("raw", "~")
    names = d.filter(d.transform("lines", "x", f"lower(trim({T.speaker_of(d, 'x')}))"), "y", "y IS NOT NULL")
    shown = d.filter(d.transform("lines", "x", f"trim({T.speaker_of(d, 'x')})"), "y", "y IS NOT NULL")
    dashes = d.size(d.filter("lines", "x", f"{T.speaker_of(d, 'x')} IS NULL AND {d.match('x', T.DASH)}"))
    return (
        f"said AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, {lines} AS lines FROM (SELECT conv_id, turn, {line} AS raw FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' AND role IS NOT NULL) a),"
        f" heard AS (SELECT *, {names} AS names, {shown} AS shown, {dashes} AS dashes FROM said),"
        f" spoken AS (SELECT conv_id, turn, lines, names, {d.join('lines', ' ')} AS cue, {d.distinct('names')} = 1 AS one, {d.item('names', '1')} AS name, {d.item('shown', '1')} AS shown_name, dashes,"
        f" {d.distinct('names')} > 1 OR dashes > 1 OR (dashes > 0 AND {d.distinct('names')} > 0) AS several,"
        f" CASE WHEN turn % 11 = 10 THEN 'last' ELSE concat('c', CAST(conv_id AS VARCHAR(20)), '-', CAST(turn + (CASE WHEN turn % 13 = 12 THEN 4 ELSE 0 END) AS VARCHAR(20))) END AS cue_id,"
        f" turn * 4000 + (CASE WHEN turn % 17 = 16 THEN -9000 ELSE 0 END) AS start_ms, turn * 4000 + 3900 - {d.mod('turn * 700 + conv_id * 300', '3000')} AS end_ms FROM heard)"
    )


def cue_speakers(d: Spark) -> str:
    """Of each cue the only speaker, whether it has several, and its dashes."""
    return f"WITH {spoken(d)} SELECT conv_id, turn, CASE WHEN one THEN shown_name END AS speaker, several, CAST(dashes AS BIGINT) AS dashes, cue_id FROM spoken"


def judged_of(d: Spark, rows: str, c: Policy = DEFAULT, last: bool = False) -> str:
    """Signals, hard reasons and penalised scores of any rows with conv_id, turn, lang, cue, speaker, several, dashes, cue_id, times and p.

    A row stands for the boundary after its cue; with `last`, the last cue of a source stays as a row without a right side.
    """
    w = "OVER (PARTITION BY conv_id ORDER BY turn)"
    columns = ("cue", "speaker", "several", "dashes", "cue_id", "start_ms")
    after = ", ".join(f"lead({x}) {w} AS r_{x}" for x in columns)
    number = lambda x: f"try_cast(nullif({d.extract(x, r'([0-9]+)$')}, '') AS DECIMAL(38, 0))"
    prefix = lambda x: d.replace(x, r"[0-9]+$", "")
    order = (
        f"WHEN r_start_ms < start_ms THEN 'cue order is invalid' WHEN {prefix('cue_id')} = {prefix('r_cue_id')} AND {number('r_cue_id')} <= {number('cue_id')} THEN 'cue order is invalid'"
        f" WHEN {prefix('cue_id')} = {prefix('r_cue_id')} AND {number('r_cue_id')} <> {number('cue_id')} + 1 THEN 'source cues are not consecutive'"
    )
    hard = (
        "CASE WHEN speaker IS NOT NULL AND r_speaker IS NOT NULL AND speaker <> r_speaker THEN 'adjacent cues have different explicit speakers'"
        " WHEN several THEN 'left cue contains multiple speakers' WHEN r_several THEN 'right cue contains multiple speakers'"
        f" WHEN r_speaker IS NOT NULL AND speaker IS NULL THEN 'right cue introduces a new explicit speaker' {order} {gap_reason(c)} {TEXT_REASON} END"
    )
    return (
        f"pairs AS (SELECT conv_id, turn, lang, cue AS lcue, r_cue AS rcue, speaker, r_speaker, several, r_several, dashes, r_dashes, cue_id, r_cue_id, start_ms, end_ms,"
        f" r_start_ms, CAST(r_start_ms - end_ms AS BIGINT) AS gap_ms, p FROM (SELECT *, {after} FROM {rows}) a{'' if last else ' WHERE r_cue IS NOT NULL'}), {signals_of(d, 'pairs')},"
        f" weighed AS (SELECT conv_id, turn, lang, lcue, rcue, gap_ms, p, issue, speaker, r_speaker, several, r_several, cue_id, r_cue_id, start_ms, end_ms, r_start_ms, {band('gap_ms', c)} AS band, independent,"
        f" CASE WHEN dashes + r_dashes > 0 THEN greatest(0, score - {c.dash_penalty}) ELSE score END AS score FROM signals), judged AS (SELECT *, {hard} AS hard FROM weighed)"
    )


def judged(d: Spark) -> str:
    p = d.mod("conv_id * 31 + turn * 17", "103")
    return (
        f"{spoken(d)}, single AS (SELECT *, 'en' AS lang, CASE WHEN one THEN name END AS speaker, CASE WHEN {p} <= 100 THEN {p} / 100.0 END AS p FROM spoken), {judged_of(d, 'single')}"
    )


def dialogue_decisions(d: Spark) -> str:
    """Speakers, order, gap and text decide first; a dash on either side takes two points off the continuation."""
    return (
        f"WITH {judged(d)} SELECT conv_id, turn, gap_ms, CAST(score AS BIGINT) AS score, hard, CASE WHEN hard IS NOT NULL THEN 'break' WHEN p IS NULL THEN 'uncertain' ELSE {soft()} END AS decision FROM judged"
    )


#: Tags of a boundary by family; the first family is what samples are drawn by.
TAGS = {
    "sampling_tags": (
        "caption", "dialogue_dash", "ellipsis_or_interruption", "explicit_speaker_change", "independent_utterance", "inverted_exclamation", "inverted_question",
        "join_like", "misleading_period", "short_response", "unknown_speaker_turn",
    ),
    "structure_tags": ("dialogue_dash", "lowercase_start", "multiline_cue_left", "multiline_cue_right", "uppercase_start"),
    "punctuation_tags": ("ellipsis_or_interruption", "inverted_exclamation", "inverted_question", "misleading_period", "terminal_punctuation_left", "terminal_punctuation_right"),
    "linguistic_tags": ("starts_with_conjunction",),
}


def dialogue_tags(d: Spark) -> str:
    """All four families of tags of adjacent cues that carry lines, speakers and dashes."""
    w = "OVER (PARTITION BY conv_id ORDER BY turn)"
    first = d.replace(f"lower({d.item(d.split('rv', '[ ]+'), '1')})", "^[¿¡.!?…]+|[¿¡.!?…]+$", "")
    holds = {
        "caption": T.caption(d, "rcue", "rv"), "dialogue_dash": "r_dashes > 0", "ellipsis_or_interruption": f"({d.match('lv', T.ELLIPSIS)} OR {d.match('rv', T.ELLIPSIS)})",
        "explicit_speaker_change": "coalesce(speaker <> r_speaker, false)", "unknown_speaker_turn": "r_dashes > 0 AND r_speaker IS NULL",
        "independent_utterance": f"({d.match('rv', r'^\p{Lu}')} AND {d.match('lv', T.STRONG_END)})", "inverted_exclamation": d.match("rv", "^¡"), "inverted_question": d.match("rv", "^¿"),
        "join_like": d.match("rv", r"^\p{Ll}"), "misleading_period": T.misleading_period(d, "lv", "rv"), "short_response": T.short_response(d, "rv"),
        "multiline_cue_left": "n_lines > 1", "multiline_cue_right": "r_n_lines > 1",
        "terminal_punctuation_left": d.match("lv", "[.?!…]$"), "terminal_punctuation_right": d.match("rv", "[.?!…]$"), "starts_with_conjunction": T.among(first, T.CONJUNCTIONS),
    }
    holds |= {"lowercase_start": holds["join_like"], "uppercase_start": holds["independent_utterance"]}
    shown = ", ".join(f"concat_ws(',', {', '.join(f'CASE WHEN {holds[t]} THEN {t!r} END' for t in tags)}) AS {family}" for family, tags in TAGS.items())
    after = ", ".join(f"lead({c}) {w} AS r_{c}" for c in ("cue", "speaker", "dashes", "n_lines"))
    return (
        f"WITH {spoken(d)}, single AS (SELECT conv_id, turn, cue, CASE WHEN one THEN name END AS speaker, dashes, {d.size('lines')} AS n_lines FROM spoken),"
        f" pairs AS (SELECT *, cue AS lcue, r_cue AS rcue FROM (SELECT *, {after} FROM single) a WHERE r_cue IS NOT NULL), plain AS (SELECT *, {T.normalised(d, 'lcue')} AS lv, {T.normalised(d, 'rcue')} AS rv FROM pairs)"
        f" SELECT conv_id, turn, {shown} FROM plain"
    )


PLANS = (cue_speakers, dialogue_decisions, dialogue_tags)
