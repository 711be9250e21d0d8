"""All queries of the engine by name, and the same in DuckDB's spelling.

Each entry is a plan written once over functions.dialect; Spark runs it over temporary views
of the tables it names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import text as T
from .functions.dialect import Duck, Spark
from .oracles import HAND_WRITTEN
from .plans import cues as P
from .plans import dialogue as D
from .plans import imports as I
from .plans import labelling as L
from .plans import readiness as Q
from .plans import requests as R
from .plans import sampling
from .plans import similarity as S

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")


def cues_from_text(d: Spark) -> str:
    return f"WITH {P.cues(d)} SELECT source_id, ordinal, cue, start_ms, end_ms FROM cues WHERE start_ms >= 0 AND start_ms <= end_ms AND trim(cue) <> ''"


def visible_text_clean(d: Spark) -> str:
    return f"SELECT page_id, {T.visible(d, 'html')} AS visible, {T.normalised(d, 'html')} AS normalised FROM pages"


def words_and_terminals(d: Spark) -> str:
    return (
        f"WITH {P.cues(d)} SELECT source_id, ordinal, {d.size(d.extract_all('cue', T.TOKEN))} AS n_tokens, {d.size(d.extract_all('cue', T.ENGLISH_WORD))} AS n_english,"
        f" {d.match('cue', T.STRONG_END)} AS strong_end, {d.match('cue', T.QUESTION_END)} AS question_end, {d.match('cue', T.DASH)} OR {d.match('cue', T.VOICE)} AS speaker_marker FROM cues"
    )


def boundaries_gap_bands(d: Spark) -> str:
    return (
        f"WITH {P.boundaries(d)} SELECT source_id, ordinal, gap_ms, greatest(0, -gap_ms) AS overlap_ms, {P.band('gap_ms')} AS band, {P.timing_band('gap_ms')} AS timing_band,"
        f" concat_ws(':', CAST(source_id AS VARCHAR(20)), CAST(ordinal AS VARCHAR(20)), CAST(ordinal + 1 AS VARCHAR(20))) AS boundary_key FROM boundaries"
    )


def speaker_hard_breaks(d: Spark) -> str:
    """Turns as labelled lines: ROLE: text; roles and dashes decide hard breaks."""
    line = "concat(upper(role), CASE WHEN turn % 3 = 2 THEN ' - ' ELSE ': ' END, text)"
    w = "OVER (PARTITION BY conv_id ORDER BY turn)"
    return (
        f"WITH said AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, {line} AS line FROM conversations WHERE text IS NOT NULL), spoken AS (SELECT conv_id, turn, line, {T.speaker_of(d, 'line')} AS speaker,"
        f" {d.match('line', T.DASH)} AS dash FROM said), pairs AS (SELECT conv_id, turn, speaker, dash, lead(speaker) {w} AS next_speaker, lead(turn) {w} AS next_turn FROM spoken)"
        f" SELECT conv_id, turn, speaker, next_speaker, dash, CASE WHEN speaker IS NOT NULL AND next_speaker IS NOT NULL AND lower(trim(speaker)) <> lower(trim(next_speaker))"
        f" THEN 'adjacent cues have different explicit speakers' WHEN next_speaker IS NOT NULL AND speaker IS NULL THEN 'right cue introduces a new explicit speaker'"
        f" WHEN next_turn <> turn + 1 THEN 'source cues are not consecutive' END AS hard_reason FROM pairs WHERE next_turn IS NOT NULL"
    )


def profile_thresholds(d: Spark) -> str:
    return (
        f"WITH {P.boundaries(d)} SELECT lang, band, CASE WHEN {P.english('lang')} THEN 'en' ELSE 'neutral' END AS profile, CAST({P.threshold(0)} AS DOUBLE) AS join_max, CAST({P.threshold(1)} AS DOUBLE) AS break_min,"
        f" count(*) AS n FROM (SELECT lang, {P.band('gap_ms')} AS band FROM boundaries) a GROUP BY lang, band"
    )


def english_signals(d: Spark) -> str:
    return f"WITH {P.signals(d)} SELECT source_id, ordinal, score, independent, issue FROM signals WHERE lang = 'en'"


def contraction_issue(d: Spark) -> str:
    """Every cue followed by each contraction mark: safe or not, and whether a space goes between."""
    marks = d.array("'''re here'", "'''m fine'", "'''ll go'", "'’t do'", "'''em all'", "', so'", "'and'")
    rows = d.unnest(marks, "source_id, ordinal, cue", "(SELECT source_id, ordinal, cue FROM cues WHERE lang = 'en') c", "m", "mark")
    return (
        f"WITH {P.cues(d)} SELECT source_id, ordinal, mark, {T.English(d).join_issue('cue', 'mark')} AS issue, {T.attaches(d, 'cue', 'mark', 'true')} AS attaches"
        f" FROM ({rows}) r"
    )


def joined_text_offsets(d: Spark) -> str:
    w = "OVER (PARTITION BY source_id ORDER BY ordinal)"
    sep = f"CASE WHEN before IS NULL THEN '' WHEN {T.attaches(d, 'before', 'cue', 'english')} THEN '' ELSE ' ' END"
    return (
        f"WITH {P.cues(d)}, paired AS (SELECT source_id, ordinal, cue, lang = 'en' AS english, lag(cue) {w} AS before FROM cues), spaced AS (SELECT source_id, ordinal, cue, {sep} AS sep FROM paired)"
        f" SELECT source_id, ordinal, sep, CAST(sum(length(sep) + length(cue)) {w} - 1 AS BIGINT) AS character_offset FROM spaced"
    )


#: Scoring windows of 48 cues with 6 of context, so a hop of 36.
WINDOW, CONTEXT, HOP = 48, 6, 36


def owned(d: Spark) -> str:
    windows = f"CASE WHEN n <= {WINDOW} THEN 1 ELSE {d.div(f'n - {WINDOW} + {HOP} - 1', str(HOP))} + 1 END"
    owner = f"greatest(0, least(k - 1, CASE WHEN ordinal < {CONTEXT} THEN 0 ELSE {d.div(f'ordinal - {CONTEXT}', str(HOP))} END))"
    return (
        f"{P.cues(d)}, counted AS (SELECT source_id, ordinal, count(*) OVER (PARTITION BY source_id) AS n FROM cues), planned AS (SELECT source_id, ordinal, n, CAST({windows} AS BIGINT) AS k FROM counted),"
        f" owned AS (SELECT source_id, ordinal, n, k, CAST({owner} AS BIGINT) AS owner FROM planned WHERE ordinal < n - 1)"
    )


def window_plan_owner(d: Spark) -> str:
    return (
        f"WITH {owned(d)} SELECT source_id, ordinal, k AS windows, owner, owner * {HOP} AS window_start, least(n, owner * {HOP} + {WINDOW}) AS window_end FROM owned"
    )


def windowed_failure_isolation(d: Spark) -> str:
    """Every 13th window fails: its own boundaries have no score and are marked, others keep theirs."""
    failed = d.mod("source_id + owner * 5", "13")
    return (
        f"WITH {owned(d)} SELECT source_id, owner, count(*) AS n_boundaries, CASE WHEN {failed} = 0 THEN 'unavailable' ELSE 'scored' END AS status,"
        f" sum(CASE WHEN {failed} = 0 THEN 0 ELSE {d.mod('source_id * 31 + ordinal * 17', '101')} END) AS score_sum FROM owned GROUP BY source_id, owner"
    ).replace("sum(CASE", "CAST(sum(CASE").replace("END) AS score_sum", "END) AS BIGINT) AS score_sum")


def policy_decisions(d: Spark) -> str:
    return f"WITH {P.decisions(d)} SELECT source_id, ordinal, decision, hard, score, independent, band, CAST(p AS DOUBLE) AS p FROM decisions"


def reconstruct_sentences(d: Spark) -> str:
    return f"WITH {P.sentences(d)} SELECT source_id, sentence_id, start_ms, end_ms, n_cues, sentence FROM sentences"


def sentence_conservation(d: Spark) -> str:
    squeeze = lambda x: d.replace(x, r"\s+", "")
    return (
        f"WITH {P.sentences(d)}, whole AS (SELECT source_id, {d.listagg('cue', '', 'ordinal')} AS t, count(*) AS n FROM cues GROUP BY source_id), kept AS"
        f" (SELECT source_id, {d.listagg('sentence', '', 'sentence_id')} AS t, CAST(sum(n_cues) AS BIGINT) AS n, count(*) AS n_sentences FROM sentences GROUP BY source_id)"
        f" SELECT w.source_id, w.n AS n_cues, n_sentences, k.n AS kept_cues, {squeeze('w.t')} = {squeeze('k.t')} AS text_kept, CAST(length({squeeze('w.t')}) AS BIGINT) AS chars FROM whole w LEFT JOIN kept k ON w.source_id = k.source_id"
    )


def high_risk_joins(d: Spark) -> str:
    """Joins that a report lists: over 1,500 ms, after a terminal, of two complete cues, or against the model; with the report's three sub-lists."""
    e = T.English(d)
    whole = lambda s: f"({e.strong(s)} OR {e.question(s)} OR {d.size(s + 'w')} = 1 OR ({d.match(s + 'v', '^[^A-Za-z]*[A-Z]')} AND {e.complete(s)}))"
    complete = f"(score = 0 AND {whole('l')} AND {whole('r')})"
    return (
        f"WITH {P.decisions(d)}, risks AS (SELECT source_id, ordinal, lcue, rcue, gap_ms, CAST(p AS DOUBLE) AS p, score, gap_ms > 1500 AS over_1500ms, {d.match('lv', T.STRONG_END)} AS terminal_left, {complete} AS both_complete FROM decisions WHERE decision = 'join')"
        f" SELECT * FROM risks WHERE over_1500ms OR terminal_left OR both_complete OR p > 0.5"
    )


#: Width of the time buckets that points and cues are joined in.
BUCKET_MS = 30_000


def active_cue_at(d: Spark) -> str:
    """The first active cue half a second into each cue and just after its end, and its sentence: cues meet points in buckets of time."""
    low, high = d.div("start_ms", str(BUCKET_MS)), d.div("end_ms", str(BUCKET_MS))
    spread = d.unnest(d.upto(f"{high} - {low} + 1"), f"source_id, ordinal, sentence_id, start_ms, end_ms, {low} AS low", "numbered", "k", "step")
    return (
        f"WITH {P.sentences(d)}, points AS (SELECT source_id, start_ms + 500 AS t FROM cues UNION SELECT source_id, end_ms + 10 FROM cues), spread AS ({spread}),"
        f" hits AS (SELECT q.source_id, q.t, n.ordinal, n.sentence_id FROM points q JOIN spread n ON n.source_id = q.source_id AND n.low + n.k = {d.div('q.t', str(BUCKET_MS))} AND n.start_ms <= q.t AND q.t < n.end_ms)"
        f" SELECT source_id, t, min(ordinal) AS ordinal, {d.least_by('sentence_id', 'ordinal')} AS sentence_id FROM hits GROUP BY source_id, t"
    )


def sentence_cue_overlap(d: Spark) -> str:
    """Ranges of cues that proposed sentences touch: spans of characters overlap, and ranges that share a cue are merged.

    Sentences and cues are both in order, so a sentence's first and last cue are found by one pass over starts of both.
    """
    w = "OVER (PARTITION BY source_id ORDER BY ordinal)"
    at = "OVER (PARTITION BY source_id ORDER BY at, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return (
        f"WITH {P.cues(d)}, {P.proposed(d)}, marks AS (SELECT source_id, start AS at, 0 AS kind, ordinal, CAST(NULL AS BIGINT) AS s FROM spans UNION ALL SELECT source_id, start, 1, NULL, s FROM sentences UNION ALL SELECT source_id, stop - 1, 2, NULL, s FROM sentences),"
        f" found AS (SELECT source_id, s, kind, max(ordinal) {at} AS ordinal FROM marks), ranges AS (SELECT source_id, s, min(ordinal) AS first_cue, max(ordinal) AS last_cue FROM found WHERE kind > 0 GROUP BY source_id, s),"
        f" cuts AS (SELECT *, CASE WHEN first_cue <= max(last_cue) OVER (PARTITION BY source_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ranges),"
        f" merged AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY s) AS grp FROM cuts)"
        f" SELECT source_id, CAST(grp AS BIGINT) AS grp, min(first_cue) AS first_cue, max(last_cue) AS last_cue, count(*) AS n_sentences FROM merged GROUP BY source_id, grp"
    )


def context_frames(d: Spark) -> str:
    """Up to three cues before a boundary's left one and after its right one."""
    w = "OVER (PARTITION BY source_id ORDER BY ordinal)"
    before = ", ".join(f"lag(cue, {k}) {w}" for k in (3, 2, 1))
    after = ", ".join(f"lead(cue, {k}) {w}" for k in (2, 3, 4))
    return (
        f"WITH {P.cues(d)} SELECT source_id, ordinal, previous, following FROM (SELECT source_id, ordinal, lead(ordinal) {w} AS nxt, concat_ws(' | ', {before}) AS previous, concat_ws(' | ', {after}) AS following FROM cues) a WHERE nxt IS NOT NULL"
    )


def scenes(d: Spark) -> str:
    return f"WITH {P.scenes_of(d)} SELECT source_id, scene, first_cue, n_cues, start_ms, end_ms FROM scenes"


def tagged(d: Spark) -> str:
    """Boundaries with their sampling tags as booleans."""
    return (
        f"{P.boundaries(d)}, plain AS (SELECT source_id, lang, ordinal, gap_ms, lcue, rcue, {T.normalised(d, 'lcue')} AS lv, {T.normalised(d, 'rcue')} AS rv FROM boundaries),"
        f" tagged AS (SELECT source_id, lang, ordinal, gap_ms, {P.timing_band('gap_ms')} AS timing_band, {d.match('rcue', T.DASH)} AS dialogue_dash, {T.caption(d, 'rcue', 'rv')} AS caption, {T.short_response(d, 'rv')} AS short_response,"
        f" {d.match('rv', r'^\s*¿')} AS inverted_question, {d.match('rv', r'^\s*¡')} AS inverted_exclamation, ({d.match('lv', T.ELLIPSIS)} OR {d.match('rv', T.ELLIPSIS)}) AS ellipsis_or_interruption,"
        f" {T.misleading_period(d, 'lv', 'rv')} AS misleading_period, {d.match('rv', r'^\p{Ll}')} AS join_like, ({d.match('rv', r'^\p{Lu}')} AND {d.match('lv', T.STRONG_END)}) AS independent_utterance,"
        f" {T.among(f'lower({d.item(d.split(chr(114) + chr(118), chr(32) + chr(43)), chr(49))})', T.CONJUNCTIONS)} AS starts_with_conjunction FROM plain)"
    )


TAGS = ("caption", "dialogue_dash", "ellipsis_or_interruption", "independent_utterance", "inverted_exclamation", "inverted_question", "join_like", "misleading_period", "short_response")


def sampling_tags(d: Spark) -> str:
    shown = ", ".join(f"CASE WHEN {t} THEN '{t}' END" for t in TAGS)
    return f"WITH {tagged(d)} SELECT source_id, ordinal, timing_band, concat_ws(',', {shown}) AS tags, starts_with_conjunction FROM tagged"


def tag_counts(d: Spark) -> str:
    parts = " UNION ALL ".join(f"SELECT lang, '{t}' AS tag, count(*) AS n FROM tagged WHERE {t} GROUP BY lang" for t in TAGS)
    if d.name == "spark":  # one pass: a row for each tag that holds
        pairs = ", ".join(f"CASE WHEN {t} THEN '{t}' END" for t in TAGS)
        return f"WITH {tagged(d)} SELECT lang, tag, count(*) AS n FROM (SELECT lang, explode(array_compact(array({pairs}))) AS tag FROM tagged) a GROUP BY lang, tag"
    return f"WITH {tagged(d)} {parts}"


def chains(d: Spark) -> str:
    """Runs of three or more boundaries that look like continuations, numbered within a source."""
    w = "OVER (PARTITION BY source_id ORDER BY ordinal)"
    return (
        f"WITH {tagged(d)}, flagged AS (SELECT source_id, ordinal, (join_like OR ellipsis_or_interruption) AS f FROM tagged), islands AS (SELECT source_id, ordinal, f, ordinal - row_number() OVER (PARTITION BY source_id, f ORDER BY ordinal) AS g FROM flagged),"
        f" runs AS (SELECT source_id, min(ordinal) AS first_boundary, count(*) AS n FROM islands WHERE f GROUP BY source_id, g HAVING count(*) >= 3)"
        f" SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY first_boundary) AS BIGINT) AS chain, first_boundary, n FROM runs"
    )


def stratum_counts(d: Spark) -> str:
    return (
        f"WITH {tagged(d)} SELECT coalesce(lang, '*') AS lang, coalesce(timing_band, '*') AS timing_band, count(*) AS n, count(DISTINCT source_id) AS n_sources FROM tagged"
        f" GROUP BY GROUPING SETS ((lang), (timing_band), (lang, timing_band), ())"
    )


def srt_blocks(d: Spark) -> str:
    """Cues written as subtitle blocks, hh:mm:ss,mmm, one text per source."""
    clock = lambda t: "concat_ws(':', " + ", ".join(f"lpad(CAST({x} AS VARCHAR(9)), 2, '0')" for x in (d.div(t, "3600000"), d.div(f"({t} % 3600000)", "60000"))) + f", concat(lpad(CAST({d.div(f'({t} % 60000)', '1000')} AS VARCHAR(9)), 2, '0'), ',', lpad(CAST({t} % 1000 AS VARCHAR(9)), 3, '0')))"
    block = f"concat(CAST(ordinal + 1 AS VARCHAR(9)), ' / ', {clock('start_ms')}, ' --> ', {clock('end_ms')}, ' / ', cue)"
    return f"WITH {P.cues(d)} SELECT source_id, {d.sha256(d.listagg(block, ' // ', 'ordinal'))} AS content_sha256, count(*) AS n FROM cues GROUP BY source_id"


def source_checksums(d: Spark) -> str:
    return f"SELECT doc_id, {d.sha256('text')} AS full_sha256, substr({d.sha256('text')}, 1, 16) AS short_sha256 FROM documents"


PLANS: dict[str, Callable[[Spark], str]] = {
    f.__name__: f
    for f in (
        cues_from_text, visible_text_clean, words_and_terminals, boundaries_gap_bands, speaker_hard_breaks, profile_thresholds, english_signals,
        contraction_issue, joined_text_offsets, window_plan_owner, windowed_failure_isolation, policy_decisions, reconstruct_sentences,
        sentence_conservation, high_risk_joins, active_cue_at, sentence_cue_overlap, context_frames, scenes, chains, sampling_tags, tag_counts,
        stratum_counts, srt_blocks, source_checksums, *D.PLANS, *S.PLANS, *L.PLANS, *R.PLANS, *I.PLANS, *Q.PLANS,
    )
}


def sampled(d: Spark) -> str:
    """What a sample by quotas is drawn from: boundaries in five groups of sources, with their tags as a list."""
    held = d.array(*(f"CASE WHEN {t} THEN '{t}' END" for t in TAGS))
    h = d.sha256("concat('42:', CAST(source_id AS VARCHAR(20)), ':', CAST(ordinal AS VARCHAR(20)))")
    return (
        f"WITH {tagged(d)} SELECT concat(CAST(source_id AS VARCHAR(20)), ':', CAST(ordinal AS VARCHAR(20))) AS boundary_id, concat('g', CAST(source_id % 5 AS VARCHAR(2))) AS source, lang AS variant,"
        f" {L.pick(d, 'source_id', ('film', 'series', 'talk'))} AS type, timing_band, {d.filter(held, 'x', 'x IS NOT NULL')} AS tags, {h} AS h FROM tagged"
    )


def quota_oracle() -> str:
    """The phases of a sample one after another in DuckDB SQL, over all rows."""
    q, steps, n = sampling.Quotas(), [f"base AS MATERIALIZED ({sampled(Duck())})", "s0 AS MATERIALIZED (SELECT boundary_id FROM base WHERE false)"], 0

    def step(body: str) -> None:
        nonlocal n
        steps.append(f"s{n + 1} AS MATERIALIZED (SELECT boundary_id FROM s{n} UNION ALL {body.replace('SO_FAR', f's{n}')})")
        n += 1

    listed = [(f"list_contains(tags, '{t}')", k) for t, k in sorted(q.tags.items())] + [(f"timing_band = '{b}'", k) for b, k in sorted(q.bands.items())]
    for holds, quota in listed:
        step(f"SELECT boundary_id FROM (SELECT boundary_id, row_number() OVER (ORDER BY h) AS r FROM base WHERE {holds} AND boundary_id NOT IN (SELECT boundary_id FROM SO_FAR)) a WHERE r <= {quota} - (SELECT count(*) FROM base JOIN SO_FAR USING (boundary_id) WHERE {holds})")
    for column, quota in (("source", str(q.source)), ("variant", str(q.variant)), ("type", str(q.type))):
        step(f"SELECT boundary_id FROM (SELECT boundary_id, {column} AS v, row_number() OVER (PARTITION BY {column} ORDER BY h) AS r FROM base WHERE boundary_id NOT IN (SELECT boundary_id FROM SO_FAR)) a WHERE r <= {quota} - (SELECT count(*) FROM base b JOIN SO_FAR USING (boundary_id) WHERE b.{column} IS NOT DISTINCT FROM a.v)")
    left = f"({q.target} - (SELECT count(*) FROM SO_FAR))"
    short = f"EXISTS (SELECT 1 FROM base GROUP BY source HAVING count(*) < {q.source})"
    even = f"greatest(1, {left} // (SELECT count(DISTINCT source) FROM base))"
    step(f"SELECT boundary_id FROM (SELECT boundary_id, row_number() OVER (ORDER BY source, h) AS nth FROM (SELECT boundary_id, source, h, row_number() OVER (PARTITION BY source ORDER BY h) AS r FROM base WHERE boundary_id NOT IN (SELECT boundary_id FROM SO_FAR)) a WHERE r <= {even} - (SELECT count(*) FROM base b JOIN SO_FAR USING (boundary_id) WHERE b.source = a.source)) c WHERE NOT {short} AND nth <= {left}")
    step(f"SELECT boundary_id FROM (SELECT boundary_id, row_number() OVER (ORDER BY source, h) AS nth FROM base WHERE boundary_id NOT IN (SELECT boundary_id FROM SO_FAR)) a WHERE nth <= {left}")
    return f"WITH {', '.join(steps)} SELECT boundary_id, source, variant, type, timing_band FROM base JOIN s{n} USING (boundary_id)"


def runner(plan: Callable[[Spark], str], read: Callable[[SparkSession, str], DataFrame] = SparkSession.sql) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = plan(Spark())
        for name in TABLES:
            if re.search(rf"\b{name}\b", sql):
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return read(spark, sql)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: runner(plan) for name, plan in PLANS.items()}
#: Where a rule has many cases its oracle is written by hand; the other oracles are the plans in DuckDB's spelling.
ORACLE_SQL: dict[str, str] = {name: HAND_WRITTEN[name] if name in HAND_WRITTEN else plan(Duck()) for name, plan in PLANS.items()}
QUERIES["quota_sample"] = runner(sampled, sampling.from_sql)
ORACLE_SQL["quota_sample"] = quota_oracle()
