"""Tilted portfolios: bond leg, tilts, backtests without a loop, metrics, rotation null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgeline.params import TiltParams


def constant_maturity_return(yields: DataFrame, keys: list[str], maturity: int = 10, freq: int = 2) -> DataFrame:
    """Adds bond_ret: a par bond struck at the yield before, priced at today's a day closer to maturity, and its accrued coupon; 0 where a yield is missing or 0. yields (keys, session, yield_pct)."""
    w = Window.partitionBy(*keys).orderBy("session")
    y, before = F.col("yield_pct") / 100.0, F.lag("yield_pct").over(w) / 100.0
    n, r = (maturity - 1.0 / 252.0) * freq, y / freq
    disc = F.pow(1.0 + r, F.lit(-n))
    price = before / freq * (1.0 - disc) / F.nullif(r, F.lit(0.0)) + disc
    return yields.withColumn("bond_ret", F.coalesce(price - 1.0 + before / 252.0, F.lit(0.0)))


def tilts(signal: DataFrame, variants: list[tuple[str, float, int]], keys: list[str]) -> DataFrame:
    """A row for each variant (variant, delta, hold) and row of signal (keys, session, event, score), with tilt.

    The tilt is delta for hold sessions from each event with score 3 or more (V1),
    or delta by score up to 4, from 1 (V2). A new event starts anew and never
    stacks. One window serves all variants.
    """
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(float(x)).alias("delta"), F.lit(h).alias("hold")) for v, x, h in variants])
    rows = signal.select("*", F.inline(each))
    w = Window.partitionBy(*keys, "variant", "delta", "hold").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("variant") == "V1"
    trig = F.coalesce(F.col("event") & (F.col("score") >= F.when(first, 3).otherwise(1)), F.lit(False))
    size = F.when(first, F.col("delta")).otherwise(F.col("delta") * (F.least(F.greatest(F.col("score"), F.lit(0)), F.lit(4)) / 4.0))
    last = F.last(F.when(trig, F.struct(F.col("session").alias("s"), size.alias("x"))), ignorenulls=True).over(w)
    return rows.withColumn("tilt", F.when(F.col("session") - last["s"] < F.col("hold"), last["x"]).otherwise(0.0))


def tilt(signal: DataFrame, variant: str, delta: float, hold: int, keys: list[str]) -> DataFrame:
    """The tilt of one variant."""
    return tilts(signal, [(variant, delta, hold)], keys).drop("variant", "delta", "hold")


def backtest(rows: DataFrame, keys: list[str], p: TiltParams = TiltParams()) -> DataFrame:
    """Adds equity, moved and traded for rows (keys, session, date, px, bond_ret, tilt).

    Trades to the target at month ends and where the target changes, and pays for
    what moves. Between trades the two legs' growth is a running product from the
    last trade, so the drifted weight is known without a loop over days.
    """
    w = Window.partitionBy(*keys).orderBy("session")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = rows.withColumn("target", F.least(F.greatest(p.base + F.coalesce("tilt", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    month, first = F.trunc("date", "MM"), F.row_number().over(w) == 1
    df = df.select("*", F.coalesce(F.col("px") / F.lag("px").over(w) - 1.0, F.lit(0.0)).alias("eq"), F.when(first, 0.0).otherwise(F.coalesce("bond_ret", F.lit(0.0))).alias("bd"), F.coalesce(month != F.lead(month).over(w), F.lit(False)).alias("rebal"), first.alias("first"), (F.col("target") != F.lag("target").over(w)).alias("changed"))
    df = df.withColumn("trade", ~F.col("first") & (F.col("rebal") | F.coalesce("changed", F.lit(False))))
    df = df.select("*", F.coalesce(F.sum(F.col("trade").cast("int")).over(before), F.lit(0)).alias("seg"), F.coalesce(F.last(F.when(F.col("trade") | F.col("first"), F.col("target")), ignorenulls=True).over(before), F.col("target")).alias("w0"))
    s = Window.partitionBy(*keys, "seg").orderBy("session")
    grow = lambda c: F.exp(F.sum(F.log1p(c)).over(s.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("e", F.col("w0") * grow("eq")).withColumn("v", F.col("e") + (1.0 - F.col("w0")) * grow("bd"))
    df = df.withColumn("moved", F.when(F.col("trade") & (F.abs(F.col("target") - F.col("e") / F.col("v")) > p.min_trade), F.abs(F.col("target") - F.col("e") / F.col("v"))).otherwise(0.0))
    df = df.withColumn("factor", F.col("v") / F.coalesce(F.lag("v").over(s), F.lit(1.0)) - F.col("moved") * p.cost_bps / 10000.0)
    return df.withColumn("equity", F.exp(F.sum(F.log("factor")).over(run))).drop("eq", "bd", "rebal", "first", "changed", "seg", "w0", "e", "v", "factor")


def metrics(curves: DataFrame, keys: list[str], p: TiltParams = TiltParams()) -> DataFrame:
    """CAGR, volatility, their quotient, the worst fall and yearly turnover of equity curves; none for fewer than two returns."""
    w = Window.partitionBy(*keys).orderBy("session")
    df = curves.select("*", (F.col("equity") / F.lag("equity").over(w) - 1.0).alias("r"), (F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1.0).alias("dd"))
    out = df.groupBy(*keys).agg(F.count("r").alias("n"), F.max_by("equity", "session").alias("final"), (F.stddev_samp("r") * F.sqrt(F.lit(p.year))).alias("vol"), F.min("dd").alias("max_dd"), F.sum("moved").alias("turnover")).where("n >= 2")
    years = F.col("n") / p.year
    out = out.withColumn("years", years).withColumn("cagr", F.pow("final", 1 / years) - 1.0).withColumn("turnover_per_year", F.col("turnover") / years)
    return out.withColumn("sharpe", F.col("cagr") / F.when(F.col("vol") > 0, F.col("vol"))).select(*keys, "cagr", "vol", "sharpe", "max_dd", "years", "turnover_per_year")


def tilt_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Days with a tilt, their share, and how often one begins."""
    w = Window.partitionBy(*keys).orderBy("session")
    on = F.col("tilt") > 0
    df = rows.select(*keys, on.alias("on"), (on & ~F.coalesce(F.lag("tilt").over(w) > 0, F.lit(False))).alias("begins"))
    return df.groupBy(*keys).agg(F.count_if("on").alias("days_tilted"), F.avg(F.col("on").cast("double")).alias("share_tilted"), F.count_if("begins").alias("n_tilts"))


def rotations(rows: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """rows (session from 1 without gaps, px, bond_ret, date, tilt) with the tilt rotated by a drawn number of sessions for each draw."""
    from surgeline.operators.study import start_of

    n = rows.agg(F.count("*").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    shifts = n.select("draw", "n", (start_of(F.col("n") - 1, F.lit(seed), F.col("draw")) + 1).alias("k"))
    base = rows.select(F.col("session").alias("from"), "tilt")
    # only sessions with a tilt are moved; the others are 0 wherever they land
    moved = base.where("tilt <> 0").join(F.broadcast(shifts)).select("draw", ((F.col("from") - 1 + F.col("k")) % F.col("n") + 1).alias("session"), "tilt")
    every = rows.drop("tilt").select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    return every.join(moved, ["draw", "session"], "left").withColumn("tilt", F.coalesce("tilt", F.lit(0.0)))


def null_points(measured: DataFrame) -> DataFrame:
    q = lambda c, p: F.percentile(c, F.lit(p))
    return measured.agg(q("sharpe", 0.05).alias("sharpe_p05"), q("sharpe", 0.5).alias("sharpe_p50"), q("sharpe", 0.95).alias("sharpe_p95"), q("cagr", 0.5).alias("cagr_p50"), q("cagr", 0.95).alias("cagr_p95"))
