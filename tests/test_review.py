"""Rules and labels of a caller's own ledger."""

import pytest

from tessera.review import apply_reviews, ledger_faults
from tessera.sources.files import LEDGER, LedgerTable


def event(seq, boundary, reviewer="ana", round=1, label="JOIN", confidence="high", kind="review", **change):
    row = {"event_id": str(seq), "event_type": kind, "boundary_id": boundary, "review_id": f"r{seq}", "reviewer_id": reviewer, "review_round": None if kind == "adjudication" else round, "label": label, "confidence": confidence, "reason": "why", "created_at": f"2024-01-{seq:02d}T00:00:00Z", "label_origin": "human", "seq": seq}
    return tuple((row | change).values())


def frame(spark, *events):
    return spark.createDataFrame(list(events), LEDGER)


@pytest.fixture
def candidates(spark):
    return spark.createDataFrame([(f"b{i}", "old") for i in range(1, 9)], "boundary_id string, review_status string")


def test_faults(spark, candidates):
    events = frame(
        spark, event(1, "b1"), event(2, "b1", "ben", 2), event(3, "b2", round=2), event(4, "b3"), event(5, "b3", round=2), event(6, "b4", label=None), event(7, "b4", "ben", reviewer_id=None), event(8, "zz"),
        event(9, "b5", kind="note"), event(10, "b6", kind="adjudication"), event(11, "b7", review_round=3, confidence="sure", reason=" ", created_at=None, label_origin=None, review_id="r1"),
    )
    found = {(r["boundary_id"], r["seq"], r["error"]) for r in ledger_faults(events, candidates).collect()}
    assert found == {
        ("b2", 3, "round two without round one"), ("b3", -1, "one reviewer did both rounds"), ("b4", 6, "invalid label"), ("b4", 7, "missing reviewerId"), ("zz", 8, "unknown boundaryId"),
        ("b5", 9, "unknown eventType"), ("b6", -1, "adjudication without disagreement"), ("b7", 11, "duplicate reviewId"), ("b7", 11, "reviewRound not 1 or 2"), ("b7", 11, "invalid confidence"),
        ("b7", 11, "invalid labelOrigin"), ("b7", 11, "missing or empty reason"), ("b7", 11, "missing createdAt"),
    }


def test_apply(spark, candidates):
    events = frame(
        spark, event(1, "b1"), event(2, "b2", label="JOIN", confidence="low"), event(3, "b3"), event(4, "b3", "ben", 2, "BREAK"), event(5, "b4"), event(6, "b4", "ben", 2, "BREAK"), event(7, "b4", "cruz", label="BREAK", kind="adjudication"),
        event(8, "b5", confidence="low"), event(9, "b5", "ben", 2),
    )
    rows = {r["boundary_id"]: (r["gold_label"], r["reviewer_count"], r["needs_second_review"], r["review_status"], r["label_origin"]) for r in apply_reviews(candidates, events).collect()}
    assert rows == {
        "b1": ("JOIN", 1, False, "reviewed", "human"), "b2": ("JOIN", 1, True, "reviewed", "human"), "b3": (None, 2, False, "needs_adjudication", "human"), "b4": ("BREAK", 2, False, "adjudicated", "human"),
        "b5": ("AMBIGUOUS", 2, False, "reviewed", "human"), **{f"b{i}": (None, 0, False, "unreviewed", None) for i in (6, 7, 8)},
    }


def test_append_checks_old_and_new(spark, candidates, tmp_path):
    table = LedgerTable(spark, str(tmp_path / "ledger"))
    assert table.append(frame(spark, event(1, "b1")), candidates) == 1
    with pytest.raises(ValueError, match="one reviewer did both rounds"):
        table.append(frame(spark, event(2, "b1", round=2)), candidates)
    with pytest.raises(ValueError, match="unknown boundaryId"):
        table.append(frame(spark, event(2, "b9")), candidates)
    assert table.append(frame(spark, event(2, "b1", "ben", 2)), candidates) == 2 and table.read().count() == 2
