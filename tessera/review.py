"""The rules of a review ledger, and the labels that follow from it, for a caller's own events.

Events have the columns of sources.files.LEDGER; seq is their order. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import D, query_over
from .plans.labelling import errors_of, states_of


def _plain(events: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return events.select(
        F.col("seq").cast("long").alias("seq"), text("event_type").alias("event_type"), text("boundary_id").alias("boundary_id"), text("review_id").alias("review_id"), text("reviewer_id").alias("reviewer"),
        F.col("review_round").cast("long").alias("round"), text("label").alias("label"), text("confidence").alias("confidence"), text("reason").alias("reason"), text("label_origin").alias("origin"),
        F.nullif(text("created_at"), F.lit("")).alias("created_at"),
    )


def ledger_faults(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """boundary_id, seq (-1: the boundary's events together) and error, a row for each rule that is broken; candidates have boundary_id."""
    known = candidates.select(F.col("boundary_id").alias("bid")).distinct()
    return query_over(f"WITH {errors_of(D)}", ledger=_plain(events), known=known)


def review_states(events: DataFrame) -> DataFrame:
    """Of each boundary with events: gold_label, label_confidence, reviewer_count, needs_second_review, review_reason, review_status, label_origin."""
    sql = f"WITH {states_of(D)} SELECT boundary_id, gold_label, label_confidence, reviewer_count, coalesce(needs_second_review, false) AS needs_second_review, review_reason, review_status, label_origin FROM states"
    return query_over(sql, ledger=_plain(events))


def apply_reviews(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """The candidates with the columns of review_states; those without events are unreviewed, and columns of these names are replaced."""
    found = review_states(events)
    new = [c for c in found.columns if c != "boundary_id"]
    joined = candidates.drop(*new).join(found, "boundary_id", "left")
    empty = {"reviewer_count": F.lit(0).cast("long"), "needs_second_review": F.lit(False), "review_reason": F.lit(""), "review_status": F.lit("unreviewed")}
    return joined.withColumns({c: F.coalesce(c, v) for c, v in empty.items()})
