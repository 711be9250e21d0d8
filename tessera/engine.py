"""Sentences of a caller's own cues: scores of a pluggable model, the policy, sentences, timeline look-ups and evaluation.

Cues have source_id, ordinal (the order in a source; gaps are fine), segment_id, text, start_ms and end_ms, as
sources.subtitles reads them; of lang (null or absent: English), lines, speaker and several each may be absent.
Rows without text, source or ordinal are no cues: `check` names them, the other functions leave them out.

Everything is one shuffle by source, or by window of a source: a source of any length is sorted, never collected; what is
collected is a window, of Windows.size cues and one more, and the parts of one sentence.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .functions.dialect import Spark
from .plans.cues import english, soft, soft_reason
from .plans.dialogue import judged_of
from .plans.policy import DEFAULT, Policy, Windows

#: A model of one text: a probability of a sentence end after each of its characters.
Model = Callable[[str], Sequence[Any]]

MAX_TEXT = 5_000
D = Spark()
OPTIONAL = {"lang": "string", "lines": "array<string>", "speaker": "string", "several": "boolean", "raw_text": "string"}
SCORES = "source_id {}, ordinal long, character_offset long, p double, status string"


def query_over(sql: str, **tables: DataFrame) -> DataFrame:
    """The SQL with each table's name standing for the DataFrame; views have fresh names and go again once the plan is made."""
    spark, names = next(iter(tables.values())).sparkSession, {}
    try:
        for name, df in tables.items():
            names[name] = f"{name}_{uuid.uuid4().hex}"
            df.createOrReplaceTempView(names[name])
        with_views = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in names.items())
        return spark.sql(sql.replace("WITH ", f"WITH {with_views}, ", 1))
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def _complete(cues: DataFrame) -> DataFrame:
    """The cues' known columns, in full; rows that are no cues are left out."""
    named = [F.col(c) if c in cues.columns else F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items()]
    wanted = ("source_id", F.col("ordinal").cast("long").alias("ordinal"), "segment_id", "text", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))
    return cues.select(*wanted, *named).where("source_id IS NOT NULL AND ordinal IS NOT NULL AND trim(text) <> ''")


def check(cues: DataFrame) -> DataFrame:
    """source_id, ordinal, segment_id and error of cues that a request would be refused for."""
    cue = Window.partitionBy("source_id").orderBy("ordinal")
    error = (
        F.when(F.col("source_id").isNull() | F.col("ordinal").isNull(), "no place").when(F.coalesce(F.trim("segment_id"), F.lit("")) == "", "empty cue id")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "missing text").when(F.length(F.trim("text")) > MAX_TEXT, "text too long")
        .when(F.col("start_ms").isNull() | F.col("end_ms").isNull() | (F.col("start_ms") < 0), "invalid times").when(F.col("end_ms") < F.col("start_ms"), "end before start")
        .when(F.col("n") > 1, "duplicate cue id").when(F.col("start_ms") < F.col("before"), "start times are not in order")
    )
    twice = cues.groupBy(F.col("source_id").alias("__s"), F.col("segment_id").alias("__c")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    timed = cues.withColumn("before", F.lag("start_ms").over(cue))
    counted = timed.join(twice, F.col("source_id").eqNullSafe(F.col("__s")) & F.col("segment_id").eqNullSafe(F.col("__c")), "left")
    return counted.select("source_id", "ordinal", "segment_id", error.alias("error")).where("error IS NOT NULL")


def probabilities(raw: Any, expected: int) -> list[float]:
    """A model's answer as floats; ValueError unless it is one finite number within [0, 1] for each character."""
    if isinstance(raw, (str, bytes)):
        raise ValueError("probabilities must be numbers")
    values = raw.tolist() if hasattr(raw, "tolist") else list(raw)
    if not isinstance(values, list) or len(values) != expected:
        raise ValueError(f"expected {expected} probabilities")
    found = []
    for value in values:
        if isinstance(value, (list, tuple)):
            if len(value) != 1:
                raise ValueError("a character has one probability")
            value = value[0]
        if isinstance(value, (str, bytes, bool)) or value is None:
            raise ValueError("probabilities must be numbers")
        number = float(value)
        if not (math.isfinite(number) and 0 <= number <= 1):
            raise ValueError("probabilities lie within [0, 1]")
        found.append(number)
    return found


def score_boundaries(cues: DataFrame, load: Callable[[], Model], windows: Windows = Windows()) -> DataFrame:
    """source_id, ordinal (of the left cue), character_offset in its window's text, p and status for every pair of adjacent cues.

    `load` is called once a Python worker's task and gives the model. A window that the model fails on, or answers
    wrongly, has null probabilities and the status 'unavailable' for the boundaries it owns; no other window does.
    """
    by = Window.partitionBy("source_id").orderBy("ordinal")
    size, hop, context = windows.size, windows.hop, windows.context
    said = f"{english('lang')}"
    placed = _complete(cues).select("source_id", "ordinal", "text", "lang", F.lag("text").over(by).alias("before"), (F.row_number().over(by) - 1).cast("long").alias("pos"))
    sep = F.expr(f"CASE WHEN before IS NULL THEN '' WHEN {T.attaches(D, 'trim(before)', 'trim(text)', said)} THEN '' ELSE ' ' END")
    first = f"greatest(CAST(0 AS BIGINT), (pos - {size} + {hop} - 1) div {hop})"  # a window sees one cue past its end, so that it knows if it is the last
    spread = placed.select("source_id", "ordinal", "pos", F.trim("text").alias("text"), sep.alias("sep"), F.explode(F.expr(f"sequence({first}, pos div {hop})")).alias("w"))
    # dealt by window, so that the model's work on one long source is spread over tasks
    grouped = spread.repartition("source_id", "w").groupBy("source_id", "w").agg(F.sort_array(F.collect_list(F.struct("pos", "ordinal", "sep", "text"))).alias("cues"))
    needed = grouped.where((F.col("w") == 0) | (F.size("cues") > 2 * context)).where(F.size("cues") > 1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            rows = []
            for source, w, seen in zip(batch["source_id"], batch["w"], batch["cues"]):
                here, last = seen[:size], len(seen) <= size
                text, ends = "", []
                for i, c in enumerate(here):
                    text += (c["sep"] if i else "") + c["text"]
                    ends.append(len(text) - 1)
                low, high = (context if w else 0), (len(here) - 2 if last else size - context - 1)
                try:
                    model = model or load()
                    p, status = probabilities(model(text), len(text)), "scored"
                except Exception:  # any fault of a model is this window's alone
                    p, status = None, "unavailable"
                rows += [(source, here[i]["ordinal"], ends[i], p[ends[i]] if p else None, status) for i in range(low, high + 1)]
            yield pd.DataFrame(rows, columns=["source_id", "ordinal", "character_offset", "p", "status"])

    return needed.mapInPandas(score, SCORES.format(cues.schema["source_id"].dataType.simpleString()))


def _judged(cues: DataFrame, scores: DataFrame, policy: Policy) -> tuple[str, dict[str, DataFrame]]:
    """Named sub-queries up to `decided`: every cue with the decision after it; the last cue of a source has no right side."""
    names = "transform(heard, x -> lower(trim(x)))"
    heard = f"filter(transform(shown, x -> {T.speaker_of(D, 'x')}), y -> y IS NOT NULL)"
    dashes = f"CAST(size(filter(shown, x -> {T.speaker_of(D, 'x')} IS NULL AND {D.match('x', T.DASH)})) AS BIGINT)"
    decision = f"CASE WHEN hard IS NOT NULL THEN 'break' WHEN p IS NULL THEN 'uncertain' ELSE {soft(policy)} END"
    reason = f"CASE WHEN hard IS NOT NULL THEN hard WHEN p IS NULL THEN 'model probability is unavailable' ELSE {soft_reason(policy)} END"
    sql = (
        f"WITH listened AS (SELECT *, {heard} AS heard, {dashes} AS dashes FROM (SELECT *, coalesce(lines, array(text)) AS shown FROM cues) a),"
        f" named AS (SELECT *, {names} AS names FROM listened),"
        " single AS (SELECT c.source_id AS conv_id, c.ordinal AS turn, c.lang, trim(c.text) AS cue, c.dashes, c.segment_id AS cue_id, c.start_ms, c.end_ms, CASE WHEN isnan(e.p) OR NOT e.p BETWEEN 0 AND 1 THEN NULL ELSE e.p END AS p,"
        " lower(coalesce(nullif(trim(c.speaker), ''), CASE WHEN size(array_distinct(names)) = 1 THEN trim(heard[0]) END)) AS speaker,"
        " size(array_distinct(names)) > 1 OR dashes > 1 OR (dashes > 0 AND size(names) > 0) OR coalesce(c.several, false) AS several"
        " FROM named c LEFT JOIN scores e ON e.source_id = c.source_id AND e.ordinal = c.ordinal),"
        f" {judged_of(D, 'single', policy, last=True)}, decided AS (SELECT *, {decision} AS decision, {reason} AS reason FROM judged)"
    )
    return sql, {"cues": _complete(cues), "scores": scores.select("source_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("p").cast("double").alias("p"))}


def decide(cues: DataFrame, scores: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """source_id, ordinal, left_segment_id, right_segment_id, decision (join, break, uncertain), reason, p, gap_ms of adjacent cues.

    `scores` has one row at most for a source_id and ordinal; a missing, null or impossible p is no evidence.
    """
    sql, tables = _judged(cues, scores, policy)
    return query_over(f"{sql} SELECT conv_id AS source_id, turn AS ordinal, cue_id AS left_segment_id, r_cue_id AS right_segment_id, decision, reason, p, gap_ms FROM decided WHERE rcue IS NOT NULL", **tables)


def reconstruct(cues: DataFrame, scores: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """source_id, sentence_id, text, start_ms, end_ms, segment_ids and parts (segment_id, text, start_ms, end_ms) of sentences: runs of joined cues."""
    sql, tables = _judged(cues, scores, policy)
    w = "OVER (PARTITION BY conv_id ORDER BY turn)"
    sep = f"CASE WHEN NOT joins THEN '' WHEN {T.attaches(D, 'before', 'cue', english('lang'))} THEN '' ELSE ' ' END"
    part = "struct(turn, concat(sep, cue) AS piece, cue_id AS segment_id, cue AS text, start_ms, end_ms)"
    return query_over(
        f"{sql}, numbered AS (SELECT *, CAST(sum(CASE WHEN joins THEN 0 ELSE 1 END) {w} AS BIGINT) - 1 AS sentence_id FROM"
        f" (SELECT conv_id, turn, lang, lcue AS cue, cue_id, start_ms, end_ms, lag(lcue) {w} AS before, coalesce(lag(decision) {w} = 'join', false) AS joins FROM decided) a),"
        f" spaced AS (SELECT *, {sep} AS sep FROM numbered), grouped AS (SELECT conv_id, sentence_id, array_sort(collect_list({part})) AS c FROM spaced GROUP BY conv_id, sentence_id)"
        f" SELECT conv_id AS source_id, sentence_id, array_join(c.piece, '') AS text, c[0].start_ms AS start_ms, try_element_at(c, -1).end_ms AS end_ms, c.segment_id AS segment_ids,"
        f" transform(c, x -> struct(x.segment_id, x.text, x.start_ms, x.end_ms)) AS parts FROM grouped",
        **tables,
    )


def active_at(cues: DataFrame, sentences: DataFrame, points: DataFrame, bucket_ms: int = 30_000) -> DataFrame:
    """Points (source_id, t) with the segment_id of the first cue that runs at t, and its sentence_id; both null where none does.

    Cues and points meet in buckets of time, so that a long source is split over tasks.
    """
    timed = _complete(cues).where("start_ms <= end_ms").select("source_id", "ordinal", "segment_id", "start_ms", "end_ms", F.explode(F.expr(f"sequence(start_ms div {bucket_ms}, end_ms div {bucket_ms})")).alias("bucket"))
    asked = points.select("source_id", F.col("t").cast("long").alias("t")).distinct().withColumn("bucket", F.expr(f"t div {bucket_ms}"))
    hits = asked.join(timed, ["source_id", "bucket"], "left")
    running = F.when((F.col("start_ms") <= F.col("t")) & (F.col("t") < F.col("end_ms")), F.struct("ordinal", "segment_id"))
    first = hits.groupBy("source_id", "t").agg(F.min(running)["segment_id"].alias("segment_id"))
    where = sentences.select("source_id", "sentence_id", F.explode("segment_ids").alias("segment_id"))
    return first.join(where, ["source_id", "segment_id"], "left").select("source_id", "t", "segment_id", "sentence_id")


#: How long each cue of a case without source lasts.
CASE_MS = 1_000


def case_cues(cases: DataFrame) -> DataFrame:
    """Cues of evaluation cases (case_id, previous, left_text, right_text, next, gap_ms): each case is a source of its own.

    The cues follow each other without a pause, but for gap_ms before the right one.
    """
    before = F.coalesce("previous", F.array().cast("array<string>"))
    texts = F.concat(before, F.array("left_text", "right_text"), F.coalesce("next", F.array().cast("array<string>")))
    listed = cases.select(F.col("case_id").alias("source_id"), F.coalesce("gap_ms", F.lit(0)).cast("long").alias("gap_ms"), F.size(before).alias("left_at"), F.posexplode(texts).alias("ordinal", "text"))
    kind = F.when(F.col("ordinal") < F.col("left_at"), F.concat(F.lit("previous-"), F.col("ordinal"))).when(F.col("ordinal") == F.col("left_at"), "left").when(F.col("ordinal") == F.col("left_at") + 1, "right")
    start = F.col("ordinal").cast("long") * CASE_MS + F.when(F.col("ordinal") > F.col("left_at"), F.col("gap_ms")).otherwise(0)
    return listed.select("source_id", "ordinal", F.coalesce(kind, F.concat(F.lit("next-"), F.col("ordinal") - F.col("left_at") - 2)).alias("segment_id"), "text", start.alias("start_ms"), (start + CASE_MS).alias("end_ms"))


def evaluate(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row of counts and shares: cases (case_id, left_text, right_text, gap_ms, expected) against the decisions of case_cues.

    Ambiguous cases are counted and left out; of cases with the same texts and gap the first case_id counts. All but a
    join is a break. A case without a decision counts as a break.
    """
    told = decisions.where("left_segment_id = 'left' AND right_segment_id = 'right'").select(F.col("source_id").alias("case_id"), F.when(F.col("decision") == "join", "join").otherwise("break").alias("predicted"))
    both = cases.select("case_id", "left_text", "right_text", "gap_ms", F.lower("expected").alias("expected")).join(told, "case_id", "left").withColumn("predicted", F.coalesce("predicted", F.lit("break")))
    first = F.row_number().over(Window.partitionBy("left_text", "right_text", "gap_ms", F.col("expected") == "ambiguous").orderBy("case_id")) == 1
    n = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long")
    share = lambda a, b: F.when(n(b) == 0, F.lit(0.0)).otherwise(n(a) / n(b))
    labelled = "first AND expected <> 'ambiguous'"
    hit, said, due = f"{labelled} AND expected = 'join' AND predicted = 'join'", f"{labelled} AND predicted = 'join'", f"{labelled} AND expected = 'join'"
    held, breaks = f"{labelled} AND expected = 'break' AND predicted = 'break'", f"{labelled} AND expected = 'break'"
    return both.withColumn("first", first).agg(
        F.count(F.lit(1)).alias("n_cases"), n("expected = 'ambiguous'").alias("n_ambiguous"), n(due).alias("expected_join"), n(breaks).alias("expected_break"), n(said).alias("predicted_join"),
        n(hit).alias("true_join"), n(held).alias("true_break"), share(hit, said).alias("join_precision"), share(hit, due).alias("join_recall"), share(held, breaks).alias("break_accuracy"),
        n(f"{breaks} AND predicted = 'join'").alias("false_merges"), n(f"{due} AND predicted <> 'join'").alias("missed_joins"),
    )


def source_differences(cases: DataFrame, cues: DataFrame) -> DataFrame:
    """case_id, side and cue_id of cases whose text is not the text of the cue they name, or whose cue is missing."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_cue_id").alias("cue_id"), F.col(f"{s}_text").alias("t")) for s in ("left", "right")))
    named = cases.select("case_id", F.explode(sides).alias("s")).select("case_id", "s.*").where("cue_id IS NOT NULL")
    known = cues.select(F.col("segment_id").alias("cue_id"), F.trim("text").alias("found"))
    return named.join(known, "cue_id", "left").where("found IS NULL OR found <> trim(t)").select("case_id", "side", "cue_id", F.when(F.col("found").isNull(), "missing").otherwise("different").alias("error"))
