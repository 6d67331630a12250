"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgeline.functions.chains import cut
from surgeline.functions.joins import measured

#: Values of a group that Spark's own percentile takes; values among which one is picked; buckets of a pass.
MOST, FEW, BUCKETS = 5_000_000, 100_000, 4096


def percentiles(rows: DataFrame, keys: list[str], points: dict[str, tuple[str, float]]) -> DataFrame:
    """(keys, names) of points {name: (column, share)}: percentiles with linear interpolation, null where a group has no value.

    Groups of up to MOST rows take Spark's percentile, which holds a group's values in one
    place. Where one is larger, all are narrowed down by counts (see narrowed). rows is written once first; keys have no nulls.
    """
    rows = cut(rows.select(*keys, *dict.fromkeys(c for c, _ in points.values())))
    largest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= MOST:
        return rows.groupBy(*keys).agg(*[F.percentile(c, F.lit(p)).alias(name) for name, (c, p) in points.items()])
    return narrowed(rows, keys, points)


def narrowed(rows: DataFrame, keys: list[str], points: dict[str, tuple[str, float]]) -> DataFrame:
    """As percentiles, for groups of any size: each pass counts the values between two bounds in BUCKETS of equal width, and goes on with the least and largest value of the bucket that holds the rank, until FEW are left or all are equal. NaN counts as null."""
    one = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("x"))
    values = rows.select(*keys, F.inline(F.array(*[one(name, c) for name, (c, _) in points.items()]))).where("x is not null and not isnan(x)")
    by = [*keys, "name"]
    share = F.create_map(*[F.lit(x) for name, (_, p) in points.items() for x in (name, float(p))])
    ranks = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("rank", share[F.col("name")] * (F.col("n") - 1))
    ends = F.array_distinct(F.array(F.floor("rank"), F.ceil("rank")))
    state = cut(ranks.select(*by, "rank", F.explode(ends).alias("k"), "lo", "hi", "n", F.lit(0).cast("long").alias("before")))
    within = lambda s: values.join(measured(s), by).where("x between lo and hi")
    half = lambda c: F.col(c) / 2
    bucket = F.least(F.floor((half("x") - half("lo")) / (half("hi") - half("lo")) * BUCKETS), F.lit(BUCKETS - 1))
    open_ = f"n > {FEW} and lo < hi"
    while not state.where(open_).isEmpty():
        counts = within(state.where(open_)).groupBy(*by, "rank", "k", "before", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*by, "k").orderBy("bucket"))  # at most BUCKETS rows
        counts = counts.withColumn("before", F.col("before") + upto - F.col("n")).where("k >= before and k < before + n")
        state = cut(state.where(f"not ({open_})").unionByName(counts.select(*state.columns)))
    place = F.row_number().over(Window.partitionBy(*by, "k").orderBy("x")) - 1 + F.col("before")
    picked = within(state.where("lo < hi")).withColumn("at", place).where("at = k").select(*by, "rank", "k", "x")
    picked = picked.union(state.where("lo = hi").select(*by, "rank", "k", F.col("lo").alias("x")))
    weight = F.when(F.col("rank") == F.col("k"), 1.0).otherwise(1.0 - F.abs(F.col("rank") - F.col("k")))
    found = picked.groupBy(*by).agg(F.sum(weight * F.col("x")).alias("value"))
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in points])
    return rows.select(*keys).distinct().join(out, keys, "left")
