"""Sources of price and volume panels, calendars, memberships and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, ticker: str = "s_nationkey", universe: str | None = None) -> DataFrame:
    """(universe, ticker, date, px, volume): cents per unit shipped and units, by ticker and ship date; only days with shipments."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(ticker).cast("long").alias("ticker"), (F.expr(universe).cast("string") if universe else F.lit("ALL")).alias("universe"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("units"))
    sums = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).groupBy("universe", "ticker", "date").agg(F.sum("cents").alias("cents"), F.sum("units").alias("volume"))
    return sums.select("universe", "ticker", "date", F.expr("cents div volume").alias("px"), "volume")


def calendar(cell_rows: DataFrame) -> DataFrame:
    """(universe, session, date): trading dates of each universe, numbered from 1."""
    return cell_rows.select("universe", "date").distinct().select("universe", F.row_number().over(Window.partitionBy("universe").orderBy("date")).alias("session"), "date")


def dense(cell_rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Carries each ticker's price forward over sessions without a cell, with volume 0: (universe, session, date, ticker, px, volume).

    Each cell is stretched up to the ticker's next one, so no grid of dates and tickers is built first.
    """
    last = sessions.groupBy("universe").agg(F.max("session").alias("last"))
    w = Window.partitionBy("universe", "ticker").orderBy("session")
    spans = cell_rows.join(sessions, ["universe", "date"]).drop("date").join(last, "universe")
    spans = spans.withColumn("next", F.coalesce(F.lead("session").over(w), F.col("last") + 1)).select("universe", "ticker", "px", "volume", F.col("session").alias("first"), F.explode(F.sequence("session", F.col("next") - 1)).alias("session"))
    out = spans.select("universe", "session", "ticker", "px", F.when(F.col("session") == F.col("first"), F.col("volume")).otherwise(0).cast("long").alias("volume"))
    return out.join(sessions, ["universe", "session"]).select("universe", "session", "date", "ticker", "px", "volume")


def benchmark(panel: DataFrame) -> DataFrame:
    """(universe, session, date, px): the cross-sectional mean."""
    return panel.groupBy("universe", "session", "date").agg((F.sum("px").cast("double") / F.count("px")).alias("px"))


def upsert(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Merges rows by key; where both have a key, fresh wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc("priority_"))
    both = old.withColumn("priority_", F.lit(0)).unionByName(fresh.withColumn("priority_", F.lit(1)))
    return both.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("priority_", "rank_")


def stale(old: DataFrame, end) -> DataFrame:
    """(universe, ticker, last): series whose last date is before end."""
    return old.groupBy("universe", "ticker").agg(F.max("date").alias("last")).where(F.col("last") < end)


def as_of(sessions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Members on each session: those of the last snapshot (universe, snapshot_date, ticker) on or before its date; none before the first."""
    dates = snapshots.select("universe", F.col("snapshot_date").alias("date")).distinct()
    w = Window.partitionBy("universe").orderBy("date").rangeBetween(Window.unboundedPreceding, 0)
    marked = sessions.select("universe", "date", "session").unionByName(dates.withColumn("session", F.lit(None).cast("int")))
    marked = marked.withColumn("snapshot_date", F.max(F.when(F.col("session").isNull(), F.col("date"))).over(w)).where("session is not null")
    return marked.join(snapshots, ["universe", "snapshot_date"]).select("universe", "session", "date", "ticker")


def masked(panel: DataFrame, members: DataFrame) -> DataFrame:
    """Panel rows of members only; what follows sees the gaps."""
    return panel.join(members.select("universe", "session", "ticker"), ["universe", "session", "ticker"], "left_semi")


def read_snapshots(spark: SparkSession, path: str, universe: str = "ALL", lines: bool = False) -> DataFrame:
    """Membership snapshots from JSON {"snapshots": {date: {"tickers": [...]}}}. lines: a document on each line, rather than one in each file."""
    schema = "snapshots map<string, struct<tickers: array<string>>>"
    days = spark.read.schema(schema).option("multiLine", not lines).json(path).select(F.explode("snapshots"))
    return days.select(F.lit(universe).alias("universe"), F.to_date("key").alias("snapshot_date"), F.explode("value.tickers").alias("ticker"))


def read_cache(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(ticker, date, close, volume) from JSON {"tickers": {T: {"dates", "adjClose", "volume"}}}; a missing close drops the row, a missing volume is 0. lines: a document on each line, rather than one in each file."""
    series = T.StructType([T.StructField("dates", T.ArrayType(T.StringType())), T.StructField("adjClose", T.ArrayType(T.DoubleType())), T.StructField("volume", T.ArrayType(T.LongType()))])
    schema = T.StructType([T.StructField("tickers", T.MapType(T.StringType(), series)), T.StructField("last_updated", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path).select(F.explode("tickers").alias("ticker", "s"))
    rows = rows.select("ticker", F.inline(F.arrays_zip("s.dates", "s.adjClose", "s.volume")))
    return rows.where("adjClose is not null and not isnan(adjClose)").select("ticker", F.to_date("dates").alias("date"), F.round("adjClose", 4).alias("close"), F.coalesce("volume", F.lit(0)).cast("long").alias("volume"))


def total_return_panel(series: DataFrame, close_basis: str = "TOTALRETURN", volume_basis: str = "NONE") -> DataFrame:
    """Close of one basis with the volume of another, on the close's dates; symbols need both."""
    close = series.where(F.col("basis") == close_basis).select("symbol", "date", "close")
    volume = series.where(F.col("basis") == volume_basis).select("symbol", "date", "volume")
    return close.join(volume.select("symbol").distinct(), "symbol", "left_semi").join(volume, ["symbol", "date"], "left")


def synthetic(spark: SparkSession, sessions: int = 1500, tickers: int = 480) -> DataFrame:
    """A deterministic panel with two surges, after falls of 40 sessions, at a fifth and three fifths of it. Its noise is arithmetic that SQL can repeat."""
    n = spark.range(tickers).select(F.col("id").alias("ticker")).select("ticker", F.explode(F.sequence(F.lit(1), F.lit(sessions))).alias("session"))
    m = F.lit(2147483647).cast("long")
    draw = (((F.col("ticker") * 48271 + F.col("session").cast("long") * 16807 + 7) * 48271) % m * 69621) % m
    noise = (draw % 20001 - 10000) / 10000 * 0.017
    at = [sessions // 5, sessions * 3 // 5]
    surge = sum((F.when(F.col("session").between(a, a + 11), 0.02).when(F.col("session").between(a - 40, a - 1), -0.01).otherwise(0.0) for a in at), F.lit(0.0))
    w = Window.partitionBy("ticker").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    out = n.select("*", draw.alias("draw"), (100 * F.exp(F.sum(noise + surge).over(w))).alias("close"))
    return out.select(F.lit("SYNTHETIC").alias("universe"), "session", F.expr("date_add(date'2015-01-02', session - 1)").alias("date"), "ticker", F.col("close").alias("px"), (1000 + F.col("draw") % 9000).alias("volume"))
