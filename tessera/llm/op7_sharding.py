"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ARCS arcs; a row's arc comes from the hash of doc_id and text. Every
shard owns REPLICAS points on the ring; an arc belongs to the next point clockwise.
A shard's bound is its exact share (counts differ by one at most: law `rows`). Keys
that find a shard full go on clockwise to the next point of a shard with room.

Rows of one point are ordered by arc, then hash, so whole stretches of them move
together: the overflow is planned on the counts of the points (shards x REPLICAS
numbers, whatever the table's size), and each row finds its stretch by its place.
One shuffle, of the small columns, by arc; everything is built-in functions.

Null text has size 1 and the checksum of an empty text; null or repeated ids are
placed like others; rows equal in all columns share an arc and are dealt in any order.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARCS, REPLICAS = 1 << 16, 64


def ring(shards: int) -> list[tuple[int, int]]:
    """(arc, shard) of every point, clockwise; no two points share an arc."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(REPLICAS):
            arc = int.from_bytes(hashlib.blake2b(f"{shard}/{replica}".encode(), digest_size=4).digest()) % ARCS
            while arc in taken:
                arc = (arc + 1) % ARCS
            taken[arc] = shard
    return sorted(taken.items())


def plan(points: list[tuple[int, int]], counts: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Stretches (point, first, last + 1, shard, slot of the first): where the rows of each point go."""
    n = sum(counts)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used = [0] * shards
    out = []
    for p, left in enumerate(counts):
        done, at = 0, p
        while left:
            s = points[at][1]
            take = min(left, room[s] - used[s])
            if take:
                out.append((p, done, done + take, s, used[s]))
                used[s], done, left = used[s] + take, done + take, left - take
            at = (at + 1) % len(points)
    return out


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    points = ring(shards)
    text = F.col("text").cast("string")
    key = F.xxhash64(F.col("doc_id"), text)
    arc = F.shiftrightunsigned(key, 48).cast("int")
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        key.alias("__key"),
        arc.alias("__arc"),
    )

    # The point of an arc: the first at or after it, else the first of all.
    before = F.size(F.filter(F.array(*[F.lit(a) for a, _ in points]), lambda a: a < F.col("__arc")))
    point: Column = F.when(before >= len(points), 0).otherwise(before)
    in_point = Window.partitionBy("__point").orderBy("__turn").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("__arc") > points[-1][0], F.col("__arc") - ARCS).otherwise(F.col("__arc"))
    arcs = rows.groupBy("__arc").agg(F.count("*").alias("__n"))  # ARCS rows at most
    arcs = arcs.withColumn("__point", point).withColumn("__turn", turn).withColumn("__base", F.sum("__n").over(in_point) - F.col("__n"))
    counts = [0] * len(points)
    for r in arcs.groupBy("__point").agg(F.sum("__n").alias("n")).collect():  # one row for each point of the ring
        counts[r["__point"]] = r["n"]
    stretches = plan(points, counts, shards) or [(0, 0, 0, 0, 0)]
    values = ", ".join(f"({p}, {a}L, {b}L, {s}, {slot}L)" for p, a, b, s, slot in stretches)
    where = spark.sql(f"SELECT * FROM VALUES {values} AS t(__p, __from, __to, shard, __slot)")

    in_arc = Window.partitionBy("__arc").orderBy("__key", F.col("doc_id").asc_nulls_first(), "text_crc32")
    ranked = rows.withColumn("__rank", F.row_number().over(in_arc) - 1)
    bases = arcs.select(F.col("__arc").alias("__a"), "__point", "__base")
    placed = ranked.join(F.broadcast(bases), F.col("__arc") == F.col("__a")).withColumn("__place", F.col("__base") + F.col("__rank"))
    found = placed.join(F.broadcast(where), (F.col("__point") == F.col("__p")) & (F.col("__place") >= F.col("__from")) & (F.col("__place") < F.col("__to")))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("__slot") + F.col("__place") - F.col("__from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
