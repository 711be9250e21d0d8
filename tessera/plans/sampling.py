"""A sample of boundaries by quotas: tags, then timing bands, sources, variants and types in turn, then filled up to a size.

Every choice takes the rows of least hash first, so a sample is the same on every run. A quota of q never looks past the
first q rows of its stratum, since rows chosen before count for it; so one pass that keeps the first rows of each
stratum (cut down in each partition before the shuffle) finds all rows that can be chosen, and the rest works on these.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The least numbers of rows of each tag and timing band.
TAG_QUOTAS = {
    "dialogue_dash": 10, "unknown_speaker_turn": 5, "caption": 5, "short_response": 8, "inverted_question": 8, "inverted_exclamation": 5,
    "ellipsis_or_interruption": 5, "misleading_period": 5, "join_like": 15, "independent_utterance": 15, "explicit_speaker_change": 5,
}
BAND_QUOTAS = {"501-1500ms": 20, "1501-3000ms": 10}


@dataclass(frozen=True)
class Quotas:
    """Least numbers of rows by tag, timing band, source, variant and type, and the size that a sample is filled up to."""

    target: int = 250
    source: int = 20
    variant: int = 15
    type: int = 10
    tags: dict[str, int] = field(default_factory=lambda: TAG_QUOTAS)
    bands: dict[str, int] = field(default_factory=lambda: BAND_QUOTAS)


def sample(rows: DataFrame, quotas: Quotas = Quotas(), key: str = "boundary_id") -> DataFrame:
    """The chosen rows of `rows`: key (unique), source, variant, type, timing_band, tags (array) and h, a hash to order by.

    Null strata count as one each. Tags and bands are chosen on the driver, from as many rows as their quotas sum up to.
    """
    named = (("tag", F.col("tags")), ("band", F.array("timing_band")), ("source", F.array("source")), ("variant", F.array("variant")), ("type", F.array("type")))

    def marked(kind: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    strata = F.concat(*(marked(kind, values) for kind, values in named))
    by_stratum = Window.partitionBy("__s.kind", "__s.value").orderBy("h", key)
    most = max(quotas.target, quotas.source, quotas.variant, quotas.type, *quotas.tags.values(), *quotas.bands.values())
    first = rows.withColumn("__s", F.explode(strata)).withColumn("__r", F.row_number().over(by_stratum)).where(F.col("__r") <= most)
    need = F.when(F.col("__s.kind") == "source", most).when(F.col("__s.kind") == "variant", quotas.variant).when(F.col("__s.kind") == "type", quotas.type)
    listed = {("tag", t): q for t, q in quotas.tags.items()} | {("band", b): q for b, q in quotas.bands.items()}
    for (kind, value), q in listed.items():
        need = need.when((F.col("__s.kind") == kind) & (F.col("__s.value") == value), q)
    kept = first.where(F.col("__r") <= need)
    fixed = F.max(F.col("__s.kind").isin("tag", "band")).alias("__listed")
    pool = kept.groupBy(key).agg(*(F.any_value(c).alias(c) for c in rows.columns if c != key), fixed).persist()

    chosen = set(pick_listed([r.asDict() for r in pool.where("__listed").select(key, "tags", "timing_band", "h").collect()], quotas, key))
    known = F.lit(False) if not chosen else F.col(key).isin(*chosen)
    found = pool.drop("__listed").withColumn("__in", known)
    for column, quota in (("source", quotas.source), ("variant", quotas.variant), ("type", quotas.type)):
        found = take(found, column, F.lit(quota), key)
    found = found.persist()
    sizes = found.groupBy("source").agg(F.sum(F.col("__in").cast("long")).alias("n")).agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("n"), F.min("n").alias("least")).first()
    left = quotas.target - (sizes["n"] or 0)
    if sizes["sources"] and left > 0:
        if sizes["least"] >= quotas.source:  # no source is short of its quota: the rest is dealt evenly first
            even = take(found, "source", F.lit(max(1, left // sizes["sources"])), key)
            found = add(found, even.where("__in").join(found.where("__in").select(key), key, "left_anti"), left, key)
            left = quotas.target - found.where("__in").count()
        if left > 0:
            found = add(found, found.where("NOT __in"), left, key)
    return found.where("__in").select(*rows.columns)


def pick_listed(pool: list[dict], quotas: Quotas, key: str) -> list:
    """Keys chosen for the quotas of tags and bands, one quota after the other in order of name."""
    pool = sorted(pool, key=lambda r: (r["h"], r[key]))
    chosen: dict = {}
    wanted = [("tags", t, q) for t, q in sorted(quotas.tags.items())] + [("timing_band", b, q) for b, q in sorted(quotas.bands.items())]
    for column, value, quota in wanted:
        members = [r[key] for r in pool if (value in (r["tags"] or ()) if column == "tags" else r[column] == value)]
        lacking = quota - sum(k in chosen for k in members)
        chosen |= dict.fromkeys([k for k in members if k not in chosen][: max(0, lacking)])
    return list(chosen)


def take(found: DataFrame, column: str, quota: Column, key: str) -> DataFrame:
    """Chooses rows until each value of the column has its quota."""
    have = F.sum(F.col("__in").cast("long")).over(Window.partitionBy(column))
    turn = F.row_number().over(Window.partitionBy(column, "__in").orderBy("h", key))
    return found.withColumn("__have", have).withColumn("__turn", turn).withColumn("__in", F.col("__in") | (F.col("__turn") <= quota - F.col("__have"))).drop("__have", "__turn")


def add(found: DataFrame, more: DataFrame, n: int, key: str) -> DataFrame:
    """Chooses the first n of the given rows as well, source by source."""
    extra = more.orderBy(F.col("source").asc_nulls_first(), "h", key).limit(n).select(key, F.lit(True).alias("__more"))
    return found.join(F.broadcast(extra), key, "left").withColumn("__in", F.col("__in") | F.coalesce("__more", F.lit(False))).drop("__more")


def from_sql(spark: SparkSession, sql: str) -> DataFrame:
    """The sample of the rows that the query gives, with the columns of the result."""
    return sample(spark.sql(sql)).select("boundary_id", "source", "variant", "type", "timing_band")
