"""Sentences of a caller's cues: windows and their owners, faults of models, decisions, sentences, look-ups, evaluation."""

import pytest
from pyspark.sql import functions as F

from tessera import engine as E
from tessera.plans.policy import Policy, Windows


def cues_of(spark, rows):
    """Rows of (source, ordinal, text, start, end[, speaker[, lines]])."""
    full = [(s, o, f"{s}{o}", t, a, b, *rest, *[None] * (2 - len(rest))) for s, o, t, a, b, *rest in rows]
    return spark.createDataFrame(full, "source_id string, ordinal long, segment_id string, text string, start_ms long, end_ms long, speaker string, lines array<string>")


def scores_of(spark, rows):
    return spark.createDataFrame(rows, "source_id string, ordinal long, p double")


@pytest.mark.parametrize("n", [1, 2, 13, 14, 15, 20, 21, 22, 60])
def test_windows_own_every_boundary_once(spark, n):
    windows = Windows(14, 3)
    # gaps in ordinal are no cues; a text's length tells its place
    rows = [("a", 10 * i, "x" * (i + 1), i, i) for i in range(n)]
    found = E.score_boundaries(cues_of(spark, rows), lambda: lambda text: [len(text) / 10_000] * len(text), windows).collect()
    assert sorted(r["ordinal"] for r in found) == [10 * i for i in range(n - 1)]
    starts = range(0, n, windows.hop)
    for r in found:
        pos = r["ordinal"] // 10
        owner = next(s for s in starts if (pos >= s + 3 or s == 0) and (pos <= s + 10 or s + 14 >= n))
        seen = range(owner, min(n, owner + 14))
        assert r["p"] == pytest.approx((sum(i + 1 for i in seen) + len(seen) - 1) / 10_000)
        assert r["character_offset"] == sum(i + 2 for i in range(owner, pos + 1)) - 2


def test_a_failing_window_is_alone(spark):
    rows = [("a", i, "bad" if i == 30 else "fine", i, i) for i in range(60)]

    def load():
        def model(text):
            if "bad" in text:
                raise RuntimeError("no")
            return [[0.25]] * len(text)

        return model

    found = {r["ordinal"]: r for r in E.score_boundaries(cues_of(spark, rows), load, Windows(14, 3)).collect()}
    lost = {o for o, r in found.items() if r["status"] == "unavailable"}
    assert len(found) == 59 and {r["p"] for r in found.values()} == {None, 0.25}
    assert lost == {o for o, r in found.items() if r["p"] is None} == set(range(27, 35))  # cue 30 lies in the window of cues 24 to 37 alone


@pytest.mark.parametrize("raw", ["0.5", [0.5], [0.5, "0.5"], [0.5, True], [0.5, None], [0.5, [0.1, 0.2]], [0.5, 1.5], [0.5, float("nan")]])
def test_wrong_answers(raw):
    with pytest.raises((ValueError, TypeError)):
        E.probabilities(raw, 2)


def test_decisions_and_sentences(spark):
    rows = [
        ("a", 0, "I was going to say", 0, 900), ("a", 1, "and then it stopped.", 1000, 1900), ("a", 2, "JOHN: Hello there", 2000, 2900, None, ["JOHN: Hello there"]),
        ("a", 3, "we", 3000, 3900), ("a", 4, "'re here", 4000, 4900), ("a", 5, "far away", 50_000, 50_900), ("b", 0, "only", 0, 10), ("c", 0, "quiet day", 0, 10), ("c", 1, "quiet night", 20, 30),
        ("c", 2, " ", 40, 50), ("c", 3, "more", 60, 70, "Ana"), ("c", 5, "words", 80, 90, " ANA "), ("c", 6, "end", 95, 96, "Bo"),
    ]
    cues = cues_of(spark, rows).withColumn("segment_id", F.when(F.col("source_id") == "c", F.concat(F.lit("x"), F.col("ordinal").cast("string"), F.lit("y"))).otherwise(F.col("segment_id")))
    scores = scores_of(spark, [("a", 0, 0.9), ("a", 1, 0.1), ("a", 2, 0.1), ("a", 3, 0.1), ("a", 4, 0.0), ("c", 0, 0.45), ("c", 1, float("nan")), ("c", 3, 0.2), ("c", 5, 0.0)])
    found = {(r["source_id"], r["ordinal"]): (r["decision"], r["reason"]) for r in E.decide(cues, scores).collect()}
    assert found == {
        ("a", 0): ("join", "continuation outweighs punctuation and model, score 4"),
        ("a", 1): ("break", "right cue introduces a new explicit speaker"),
        ("a", 2): ("join", "model favors continuation"), ("a", 3): ("join", "model favors continuation"),
        ("a", 4): ("break", "cue gap 45100ms exceeds extreme-gap threshold 30000ms"), ("c", 0): ("join", "model favors continuation"),
        ("c", 1): ("break", "right cue introduces a new explicit speaker"), ("c", 3): ("join", "model favors continuation"), ("c", 5): ("break", "adjacent cues have different explicit speakers"),
    }
    strict = {r["ordinal"]: r["decision"] for r in E.decide(cues.where("source_id = 'c'"), scores, Policy(normal_gap_ms=0, medium_gap_ms=5, extreme_gap_ms=8)).collect()}
    assert strict == {0: "break", 1: "break", 3: "break", 5: "break"}
    told = E.reconstruct(cues, scores)
    texts = {(r["source_id"], r["sentence_id"]): r for r in told.collect()}
    assert {k: r["text"] for k, r in texts.items()} == {
        ("a", 0): "I was going to say and then it stopped.", ("a", 1): "JOHN: Hello there we're here", ("a", 2): "far away", ("b", 0): "only",
        ("c", 0): "quiet day quiet night", ("c", 1): "more words", ("c", 2): "end",
    }
    assert texts["a", 1]["segment_ids"] == ["a2", "a3", "a4"] and (texts["a", 1]["start_ms"], texts["a", 1]["end_ms"]) == (2000, 4900)
    assert tuple(texts["a", 0]["parts"][1]) == ("a1", "and then it stopped.", 1000, 1900)
    points = spark.createDataFrame([("a", 3950), ("a", 4000), ("a", 4899), ("a", 4900), ("b", 5), ("z", 1)], "source_id string, t long")
    active = {(r["source_id"], r["t"]): (r["segment_id"], r["sentence_id"]) for r in E.active_at(cues, told, points).collect()}
    assert active == {("a", 3950): (None, None), ("a", 4000): ("a4", 1), ("a", 4899): ("a4", 1), ("a", 4900): (None, None), ("b", 5): ("b0", 0), ("z", 1): (None, None)}


def test_empty(spark):
    cues, scores = cues_of(spark, []), scores_of(spark, [])
    assert E.decide(cues, scores).count() == E.reconstruct(cues, scores).count() == E.score_boundaries(cues, lambda: None).count() == E.check(cues).count() == 0


def test_check(spark):
    rows = [("a", 0, "x", 5, 6), ("a", 1, "", 6, 7), ("a", 2, "x" * 5001, 8, 9), ("a", 3, "x", 9, 8), ("a", 4, "x", 4, 8), (None, 5, "x", 4, 8), ("a", 6, "x", None, 8), ("b", 0, "x", 1, 1), ("b", 1, "y", 2, 2)]
    cues = cues_of(spark, rows).withColumn("segment_id", F.when(F.col("source_id") == "b", "same").otherwise(F.coalesce("segment_id", F.lit("q"))))
    assert {(r["source_id"], r["ordinal"]): r["error"] for r in E.check(cues).collect()} == {
        ("a", 1): "missing text", ("a", 2): "text too long", ("a", 3): "end before start", ("a", 4): "start times are not in order", (None, 5): "no place", ("a", 6): "invalid times",
        ("b", 0): "duplicate cue id", ("b", 1): "duplicate cue id",
    }


def test_evaluate(spark):
    schema = "case_id string, previous array<string>, left_text string, right_text string, next array<string>, gap_ms long, expected string, left_cue_id string, right_cue_id string"
    rows = [
        ("1", ["Before."], "I was going to say", "and then it stopped.", ["After."], 100, "join", "k1", "k2"), ("2", None, "I was going to say", "and then it stopped.", None, 100, "break", None, None),
        ("3", [], "That is all.", "We went home.", [], 100, "break", "k1", "k9"), ("4", [], "one", "two", [], 40_000, "join", None, None), ("5", [], "one", "two", [], 100, "ambiguous", None, None),
    ]
    cases = spark.createDataFrame(rows, schema)
    cues = E.case_cues(cases)
    assert [tuple(r) for r in cues.where("source_id = '1'").orderBy("ordinal").select("segment_id", "start_ms", "end_ms").collect()] == [
        ("previous-0", 0, 1000), ("left", 1000, 2000), ("right", 2100, 3100), ("next-0", 3100, 4100),
    ]
    scores = E.score_boundaries(cues, lambda: lambda text: [0.6] * len(text))
    got = E.evaluate(cases, E.decide(cues, scores)).first()
    assert got.asDict() == {
        "n_cases": 5, "n_ambiguous": 1, "expected_join": 2, "expected_break": 1, "predicted_join": 1, "true_join": 1, "true_break": 1, "join_precision": 1.0, "join_recall": 0.5,
        "break_accuracy": 1.0, "false_merges": 0, "missed_joins": 1,
    }
    source = spark.createDataFrame([("k1", "I was going to say "), ("k2", "other")], "segment_id string, text string")
    assert {tuple(r) for r in E.source_differences(cases, source).collect()} == {("1", "right", "k2", "different"), ("3", "left", "k1", "different"), ("3", "right", "k9", "missing")}


@pytest.mark.parametrize("wrong", [{"normal_gap_ms": -1}, {"medium_gap_ms": 400}, {"extreme_gap_ms": 1500}, {"large_join_max": 0.3}, {"min_score": 0}, {"override_max": 1.1}, {"min_score": True}, {"dash_penalty": 1.5}])
def test_policy_refuses(wrong):
    with pytest.raises(ValueError):
        Policy(**wrong)


@pytest.mark.parametrize("size, context", [(13, 6), (0, 1), (48, 0), (True, 1)])
def test_windows_refuse(size, context):
    with pytest.raises(ValueError):
        Windows(size, context)
