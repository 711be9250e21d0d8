"""Readers and writers of subtitle, JSON, CSV and ledger files, and the streaming plans."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.sources import freeze
from tessera.sources import subtitles as T
from tessera.streaming import live

GOOD = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n  Hello \r\nthere.\r\n\r\n00:00:03.000 --> 01:00:04,005\r\nno id\r\n \r\n\r\n7\r\n100:00:00,000 --> 100:00:01,000\r\nlate\r\n\r\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.srt").write_bytes(GOOD.encode())
    (tmp_path / "deep" / "b.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nonly one\n")
    (tmp_path / "c.txt").write_text("no subtitles")
    return tmp_path


def test_read_cues(spark, folder):
    rows = [tuple(r) for r in T.read_cues(spark, str(folder)).orderBy("ordinal").select("source_id", "ordinal", "segment_id", "text", "start_ms", "end_ms", "raw_text").collect()]
    assert rows == [
        ("a.srt", 0, "1", "Hello there.", 1000, 2500, "  Hello \nthere."),
        ("a.srt", 1, "cue-2", "no id", 3000, 3604005, "no id"),
        ("a.srt", 2, "7", "late", 360000000, 360001000, "late"),
    ]


def test_errors(spark):
    bad = {
        "times": "1\n00:61:00,000 --> 00:00:02,000\nx", "arrow": "1\nno times\nx", "text": "1\n00:00:01,000 --> 00:00:02,000", "back": "1\n00:00:03,000 --> 00:00:02,000\nx",
        "twice": "1\n00:00:01,000 --> 00:00:02,000\nx\n\n1\n00:00:02,000 --> 00:00:03,000\ny", "order": "1\n00:00:05,000 --> 00:00:06,000\nx\n\n2\n00:00:02,000 --> 00:00:03,000\ny",
        "blank": " \n\n", "null": None,
    }
    cues = T.parse(spark.createDataFrame(list(bad.items()), "source_id string, content string")).cache()
    found = {(r["source_id"], r["error"]) for r in cues.where("error IS NOT NULL").collect()}
    assert found == {
        ("times", "invalid timing line"), ("arrow", "invalid timing line"), ("text", "missing text"), ("back", "end before start"),
        ("twice", "duplicate cue id"), ("order", "start times are not in order"),
    }
    assert not cues.where("source_id IN ('blank', 'null')").collect()
    with pytest.raises(Exception, match="missing text"):
        T.strict(cues.where("source_id = 'text'")).collect()


def test_round_trip_and_window(spark, folder, tmp_path):
    cues = T.read_cues(spark, str(folder))
    text = T.render(cues).first()["content"]
    assert text.startswith("1\n00:00:01,000 --> 00:00:02,500\nHello there.\n\n2\n00:00:03,000 --> 01:00:04,005\nno id\n\n3\n100:00:00,000") and text.endswith("late\n")
    again = T.parse(spark.createDataFrame([("a.srt", text)], "source_id string, content string"))
    assert [tuple(r) for r in again.orderBy("ordinal").select("text", "start_ms", "end_ms", "error").collect()] == [(*r, None) for r in cues.orderBy("ordinal").select("text", "start_ms", "end_ms").collect()]
    T.write_files(cues, str(tmp_path / "out"))
    assert next((tmp_path / "out" / "source_id=a.srt").glob("*.txt")).read_text().rstrip("\n") == text.rstrip("\n")
    assert T.window_of(cues, ["1", "cue-2"]).count() == 2 and T.window_of(cues, ["1", "7"]).count() == 0
    with pytest.raises(ValueError):
        T.window_of(cues, ["1", "1"])


def test_verify(spark, folder):
    have = T.read_files(spark, str(folder))
    manifest = spark.createDataFrame([("a.srt", hashlib.sha256(GOOD.encode()).hexdigest(), 3), ("gone.srt", "0", 1)], "source_id string, full_sha256 string, cue_count int")
    assert {r["source_id"]: r["status"] for r in T.verify(have, manifest).collect()} == {"a.srt": "ok", "deep/b.srt": "unregistered", "gone.srt": "missing"}


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"id": "a", "n": 1}, {"id": "b", "n": 2}]}, indent=1))
    (tmp_path / "r.json").write_text(json.dumps([{"id": "a"}, {"id": None}]))
    assert S.read_json_array(spark, str(tmp_path / "m.json"), "id string, n int", "sources").count() == 2
    assert S.read_json_array(spark, str(tmp_path / "r.json"), "id string").count() == 2
    rows = spark.createDataFrame([('q "x",\ny', [1, 2], None)], "a string, b array<int>, c string")
    S.write_csv(rows, str(tmp_path / "w"), ["a", "b", "c"])
    got = S.read_csv(spark, str(tmp_path / "w"))
    assert got.columns == ["a", "b", "c"] and got.first()["a"] == 'q "x",\ny' and json.loads(got.first()["b"]) == [1, 2]
    S.write_csv(rows.where("false"), str(tmp_path / "e"), ["a", "b"])
    assert next((tmp_path / "e").glob("*.csv")).read_text().strip() == "a,b"
    (tmp_path / "bom.csv").write_bytes("﻿id,text\n1,x\n".encode())
    assert S.read_csv(spark, str(tmp_path / "bom.csv")).columns == ["id", "text"]
    assert json.loads(S.report(rows))[0]["b"] == [1, 2]


def event(k, reviewer="ana", seq=1):
    return (f"e{k}", "review", f"b{k}", f"r{k}{reviewer}{seq}", reviewer, 1, "JOIN", "high", "why", "2024-01-01", "human", seq)


def test_ledger(spark, tmp_path):
    assert S.read_ledger(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "l.jsonl").write_text('{"boundary_id": "b1", "seq": 1}\n\n{"boundary_id": "b2", "seq": 2}\n')
    assert [r["boundary_id"] for r in S.read_ledger(spark, str(tmp_path / "l.jsonl")).orderBy("seq").collect()] == ["b1", "b2"]
    table = S.LedgerTable(spark, str(tmp_path / "ledger"))
    frame = lambda *rows: spark.createDataFrame(list(rows), S.LEDGER)
    assert table.read().count() == 0 and table.append(frame(event(1), event(2))) == 1
    assert table.append(frame(event(1), event(3))) == 2 and table.read().count() == 3  # a known review adds nothing
    with pytest.raises(ValueError):
        table.append(frame(event(1, seq=9)))
    assert table.read().count() == 3


def test_queues_resume_and_migration(spark):
    queue = spark.createDataFrame([("q", 1, "b2", "t", "JOIN"), ("q", 0, "b1", "u", None)], "queue_id string, place int, boundary_id string, text string, label string")
    one, other = S.queue_manifests(queue).first(), S.queue_manifests(queue.withColumn("label", F.lit("BREAK"))).first()
    assert one["boundary_ids"] == ["b1", "b2"] and one["row_count"] == 2 and one["content_sha256"] == other["content_sha256"]
    done = spark.createDataFrame([("b1", "run")], "boundary_id string, run_id string")
    assert [r["boundary_id"] for r in S.remaining(queue, done, "run").collect()] == ["b2"]
    with pytest.raises(Exception, match="another run"):
        S.remaining(queue, done, "else").collect()
    manifest = spark.createDataFrame([("t", "film")], "text string, kind string")
    got = {r["boundary_id"]: (r["kind"], r["tier"]) for r in S.add_missing(queue, manifest, "text", {"kind": "other", "tier": "unknown", "label": "x"}).collect()}
    assert got == {"b1": ("other", "unknown"), "b2": ("film", "unknown")}


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("source_id"), "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    reviews = stream.selectExpr("source_id AS boundary_id", "event_type AS reviewer_id", "CAST(event_id AS STRING) AS label", "event_id AS seq")
    for name, df, mode in (("scenes_s", live.live_scenes(stream), "complete"), ("reviews_s", live.live_reviews(reviews), "complete"), ("counts_s", live.gap_counts(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    n = events.count()
    assert spark.table("scenes_s").agg(F.sum("n_cues")).first()[0] == n == spark.table("counts_s").agg(F.sum("n")).first()[0]
    want = {tuple(r) for r in events.groupBy("source_id", "event_type").agg(F.max("event_id")).collect()}
    assert {(r["boundary_id"], r["reviewer_id"], r["seq"]) for r in spark.table("reviews_s").collect()} == want


def test_freeze(spark, tmp_path):
    good = {"frozen": True, "commitSha": "0a" * 20, "frozenAt": "2024-05-01T10:00:00+00:00", "notes": ""}
    freeze.require(good)
    assert freeze.errors({"frozen": False}) == []
    bad = [{"frozen": 1}, {"commitSha": "0A" * 20}, {"commitSha": None}, {"frozenAt": "May"}, {"frozenAt": None}, {"frozenAt": ""}, {"more": 1}, {"frozen": False}, {"frozen": None}]
    for change in bad:
        with pytest.raises(RuntimeError):
            freeze.require(good | change)
    assert freeze.load(spark, str(tmp_path / "none.json"))["frozen"] is False
    (tmp_path / "f.json").write_text(json.dumps(good, indent=1))
    assert freeze.load(spark, str(tmp_path / "f.json")) == good
