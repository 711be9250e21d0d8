"""Subtitle files as tables of cues and back: blocks of an optional id, a line of times and lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The file format.
CLOCK = r"^([0-9]+):([0-5][0-9]):([0-5][0-9])[,.]([0-9]{3})$"
ARROW = "-->"
BLOCKS = r"\r?\n[ \t\f\x0B\r]*\r?\n\s*"


def to_ms(clock: Column) -> Column:
    """H+:MM:SS,mmm as milliseconds; null where the text is no such clock."""
    part = [F.regexp_extract(clock, CLOCK, i) for i in range(1, 5)]
    hours, minutes, seconds, rest = (p.try_cast("long") for p in part)
    return ((hours * 60 + minutes) * 60 + seconds) * 1000 + rest


def to_clock(ms: Column) -> Column:
    ms = ms.cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """source_id (the file's place below path), content without byte-order mark, full_sha256 of the bytes; every *.srt below path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.srt").load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"^\x{FEFF}", "")
    below = F.when(F.startswith("path", F.lit(root)), F.substr("path", F.lit(len(root) + 1))).otherwise(F.regexp_extract("path", r"([^/]+)$", 1))
    return files.select(below.alias("source_id"), text.alias("content"), F.sha2("content", 256).alias("full_sha256"))


def parse(files: DataFrame) -> DataFrame:
    """Cues of source_id and content, one row each, with error: null, or what is wrong with the block.

    A block is [id, times, text...] or [times, text...]; without an id it is cue-N by its place. Rows with an error stay,
    so that a reader chooses between quarantine and failure (strict). A null or blank content has no cues.
    """
    body = F.regexp_replace("content", r"^[\r\n]+|[\r\n]+$", "")
    blocks = files.where(F.trim(F.regexp_replace("content", r"\s", "")) != "").select("source_id", F.posexplode(F.split(body, BLOCKS)).alias("ordinal", "block"))
    lines = blocks.select("source_id", F.col("ordinal").cast("long"), F.split("block", r"\r?\n").alias("all"))
    first_is_time = F.col("all")[0].contains(ARROW)
    skip = F.when(first_is_time, 0).otherwise(1)
    parts = lines.select(
        "source_id", "ordinal", F.when(first_is_time, F.concat(F.lit("cue-"), F.col("ordinal") + 1)).otherwise(F.trim(F.col("all")[0])).alias("segment_id"),
        F.split(F.get("all", skip), ARROW).alias("times"), F.slice("all", skip + 2, F.greatest(F.size("all"), F.lit(1))).alias("lines"),
    )
    start, stop = (to_ms(F.regexp_replace(F.get("times", F.lit(i)), r"^\s+|\s+$", "")) for i in (0, 1))
    shown = F.filter(F.transform("lines", lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    cues = parts.select(
        "source_id", "ordinal", "segment_id", F.array_join(shown, " ").alias("text"), start.alias("start_ms"), stop.alias("end_ms"),
        F.array_join("lines", "\n").alias("raw_text"), "lines", F.coalesce(F.size("times") == 2, F.lit(False)).alias("timed"),
    )
    before = Window.partitionBy("source_id").orderBy("ordinal")
    twice = F.count(F.lit(1)).over(Window.partitionBy("source_id", "segment_id")) > 1
    error = (
        F.when(F.col("segment_id") == "", "empty cue id").when(~F.col("timed") | F.col("start_ms").isNull() | F.col("end_ms").isNull(), "invalid timing line")
        .when(F.col("end_ms") < F.col("start_ms"), "end before start").when(F.col("text") == "", "missing text").when(twice, "duplicate cue id")
        .when(F.col("start_ms") < F.lag("start_ms").over(before), "start times are not in order")
    )
    return cues.withColumn("error", error).drop("timed")


def strict(cues: DataFrame) -> DataFrame:
    """The same cues; a row with an error fails the query when it is read."""
    message = F.concat_ws(": ", "source_id", "segment_id", "error")
    return cues.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error(message).cast("string"))).drop("error")


def read_cues(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """Sound cues of all files below path; blank cues go, and so do sources with fewer than `least`."""
    cues = parse(read_files(spark, path)).where(F.col("error").isNull() & (F.col("text") != "")).drop("error")
    n = F.count(F.lit(1)).over(Window.partitionBy("source_id"))
    return cues.withColumn("n", n).where(F.col("n") >= least).drop("n")


def window_of(cues: DataFrame, segment_ids: list[str]) -> DataFrame:
    """The cues with these ids; fails unless they are two or more, all different, present and adjacent in their source."""
    if len(segment_ids) < 2 or len(set(segment_ids)) != len(segment_ids):
        raise ValueError("a window needs two or more different cue ids")
    found = cues.where(F.col("segment_id").isin(segment_ids))
    by = found.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), (F.max("ordinal") - F.min("ordinal") + 1).alias("width")).where(f"n = {len(segment_ids)} AND n = width")
    return found.join(by.select("source_id"), "source_id", "left_semi")


def render(cues: DataFrame, text: str = "text") -> DataFrame:
    """source_id, content: the file of each source, numbered from 1 in the order of ordinal.

    A file is one value, as the format asks; sources are rendered apart from each other.
    """
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal"))
    block = F.concat_ws("\n", F.col("number").cast("string"), F.concat(to_clock(F.col("start_ms")), F.lit(f" {ARROW} "), to_clock(F.col("end_ms"))), F.col(text))
    listed = cues.withColumn("number", number).select("source_id", "number", block.alias("block"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("number", "block"))), lambda x: x["block"])
    return listed.groupBy("source_id").agg(F.concat(F.array_join(ordered, "\n\n"), F.lit("\n")).alias("content"))


def write_files(cues: DataFrame, path: str, text: str = "text") -> None:
    """One folder source_id=... a source, with one file of text in it."""
    render(cues, text).select("source_id", F.col("content").alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy("source_id").text(path)


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against a manifest of source_id, full_sha256, cue_count: source_id and status ok, missing, unregistered, checksum or count."""
    counts = parse(files).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    have = files.select("source_id", F.col("full_sha256").alias("found_sha256"), F.lit(True).alias("here")).join(counts, "source_id", "left")
    both = have.join(manifest.select("source_id", "full_sha256", "cue_count", F.lit(True).alias("known")), "source_id", "full")
    status = (
        F.when(F.col("known").isNull(), "unregistered").when(F.col("here").isNull(), "missing").when(F.col("found_sha256") != F.col("full_sha256"), "checksum")
        .when(F.coalesce("n", F.lit(0)) != F.col("cue_count"), "count").otherwise("ok")
    )
    return both.select("source_id", "found_sha256", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))
