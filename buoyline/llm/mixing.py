"""Mixing of sources to target weights along a time-varying curriculum.

Each source has a schedule: its weight over training time t in [0, 1], given at
knots and linear in between. Its integral is the source's overall weight, from
which the targets follow (no source is repeated more than `epochs` times; what
that cuts off is shared again by weight). The running integral, scaled to the
target, is the source's cumulative token demand. Documents of a source stand in
a fixed pseudo-random order; every copy that the mix takes occupies an interval
of the source's token stream, and its training position is the time at which
demand reaches the interval's middle. The corpus is range-sorted by position.

DataFrame expressions only. A hot source is spread over BUCKETS ordered buckets:
running sums are taken inside buckets, on top of a prefix over bucket totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 4096  # ordered buckets of one source, from the first 12 bits of a document's order key
WORD = r"[^\x20\x09-\x0D]+"


def words(text) -> Column:
    """Number of white-space separated words; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def ramp(weight: Column, slope: Column) -> Column:
    """Schedule of a source whose weight runs from weight*(1-slope) to weight*(1+slope)."""
    return F.array(
        F.struct(F.lit(0.0).alias("t"), (weight * (F.lit(1.0) - slope)).alias("w")),
        F.struct(F.lit(1.0).alias("t"), (weight * (F.lit(1.0) + slope)).alias("w")),
    )


def pieces(schedule: Column) -> Column:
    """Linear pieces of a schedule with the integral before each (`done`), its own (`area`), and its ends."""
    made = F.transform(F.slice(schedule, 1, F.size(schedule) - 1), lambda a, i: F.struct(
        a["t"].alias("t0"), schedule[i + 1]["t"].alias("t1"), a["w"].alias("w0"), schedule[i + 1]["w"].alias("w1"),
        ((schedule[i + 1]["t"] - a["t"]) * (a["w"] + schedule[i + 1]["w"]) / 2.0).alias("area")))
    return F.transform(made, lambda p, i: F.struct(
        p["t0"].alias("t0"), p["t1"].alias("t1"), p["w0"].alias("w0"), p["w1"].alias("w1"), p["area"].alias("area"),
        F.aggregate(F.slice(made, 1, i), F.lit(0.0), lambda s, q: s + q["area"]).alias("done")))


def integral(schedule: Column) -> Column:
    return F.aggregate(pieces(schedule), F.lit(0.0), lambda s, p: s + p["area"])


def invert(parts: Column, demand: Column) -> Column:
    """The time at which the running integral over `parts` reaches `demand` (same unit as the areas)."""
    at = F.coalesce(
        F.get(F.filter(parts, lambda p: (p["done"] + p["area"] >= demand) & (p["area"] > 0)), F.lit(0)),
        F.element_at(parts, -1))
    # Within a piece: demand - done = w0*x + slope*x^2/2; the root in the form that is stable for slope = 0.
    left = F.greatest(demand - at["done"], F.lit(0.0))
    slope = (at["w1"] - at["w0"]) / (at["t1"] - at["t0"])
    root = at["w0"] + F.sqrt(F.greatest(at["w0"] * at["w0"] + slope * left * 2.0, F.lit(0.0)))
    return F.least(F.when(root > 0, at["t0"] + left * 2.0 / root).otherwise(at["t0"]), at["t1"])


def plan(sizes: DataFrame, epochs: int, schedule=None) -> DataFrame:
    """(source, source_size, weight, schedule, target): one row per source.

    `schedule` maps the source's rank (by code point from 0, null last) to its
    knots; by default weights 1, 2, 3 repeat, and ramps fall, stay and rise.
    Targets solve sum(min(epochs * size, level * weight)) = total, which is the
    end of resharing by weight until no source is above its limit.
    """
    rank = F.col("rank")
    if schedule is None:
        weight = (F.pmod(rank, F.lit(3)) + 1).cast("double")
        schedule = ramp(weight, (F.pmod(rank, F.lit(3)) - 1).cast("double") * F.lit(0.5))
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source: these windows see the source names, never the documents.
    named = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("rank", F.row_number().over(named) - 1).withColumn("schedule", schedule)
    ranked = ranked.withColumn("weight", integral(F.col("schedule"))).withColumn("cap", F.col("source_size") * F.lit(epochs))
    tight = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        ranked.withColumn("capped", F.coalesce(F.sum("cap").over(tight), F.lit(0)))
        .withColumn("freed", F.coalesce(F.sum("weight").over(tight), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("freed")))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole))
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final")["level"], F.lit(0.0)) * F.col("weight"))
    return level.select("source", "source_size", "weight", "schedule", target.alias("target"))


def order_key(key: str) -> Column:
    return F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))


def mix(docs: DataFrame, epochs: int = 3, key: str = "doc_id", source: str = "source", text: str = "text", schedule=None) -> DataFrame:
    """One row per document: its columns, size, source_size, target, taken and positions.

    A source of size S and target T takes every document floor(T/S) times and,
    along its order, one more copy of those whose middle lies within the
    remainder, which misses the target by half a document at most. `taken` is
    size * copies; `positions` holds each copy's time in [0, 1], ascending.
    Sources of size 0 take none. Rows of one key tie on the text, then on the
    size; equal rows are interchangeable. A null source is a source of its own,
    ranked last; null keys share one place in the order. Extra columns pass.
    """
    ordered = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(key).cast("string").alias("key"), F.col(source).alias("source"),
        words(text).alias("size"), order_key(key).alias("place"), F.xxhash64(text).alias("tie"),
    ).withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    narrow = ordered.select("source", "bucket", "size")
    totals = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    sources = plan(totals.select("source", F.col("part").alias("size")), epochs, schedule)
    # Running sum over the totals of a source, BUCKETS rows at most.
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("before"))
    known = before.join(sources, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    joined = ordered.join(known, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "key", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = joined.withColumn("through", F.col("before") + F.sum("size").over(inside))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    full = F.floor(rate).cast("long")
    rest = F.col("target") - full * F.col("source_size")
    copies = full + F.when(F.col("through") - F.col("size") / 2.0 <= rest, F.lit(1)).otherwise(F.lit(0))
    run = run.withColumn("copies", F.when(F.col("target") > 0, F.least(copies, F.lit(epochs))).otherwise(F.lit(0)).cast("int")).withColumn("parts", pieces(F.col("schedule")))
    middle = F.col("through") - F.col("size") / 2.0
    places = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda i: invert(
        F.col("parts"), F.least(F.try_divide(middle + i * F.col("source_size"), F.col("target")), F.lit(1.0)) * F.col("weight")))
    return run.select(
        "row.*", F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        (F.col("size") * F.col("copies")).alias("mix_taken"),
        F.when(F.col("copies") > 0, places).otherwise(F.array().cast("array<double>")).alias("mix_positions"))


def training_order(mixed: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """One row per taken copy, range-sorted by training position (ties by key)."""
    return mixed.select(*columns, F.explode("mix_positions").alias("mix_position")).orderBy("mix_position", key)
