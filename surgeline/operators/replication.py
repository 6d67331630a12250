"""Whole studies of a universe: thresholds by its size, days that count, the cell that decides, and the gate over universes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgeline.functions.series import by, filled
from surgeline.operators import breadth as B
from surgeline.operators import portfolio as PF
from surgeline.operators import study as E
from surgeline.params import ThrustParams, TiltParams


def scaled(line_rows: DataFrame, p: ThrustParams, nominal: int = 500) -> DataFrame:
    """Rows once for each mode (mode, scale): literal keeps the count thresholds, sized multiplies them by the universe's median size over nominal."""
    size = B.scale_of(line_rows, nominal)  # a row for each universe
    modes = F.array(F.struct(F.lit("literal").alias("mode"), F.lit(1.0).alias("scale")), F.struct(F.lit("sized").alias("mode"), F.col("sized").alias("scale")))
    return line_rows.join(size.select("universe", F.col("scale").alias("sized")), "universe").select("*", F.inline(modes)).drop("sized")


def counted_days(comp: DataFrame) -> DataFrame:
    """Only sessions with data_ok, numbered anew; the old number is day."""
    rows = comp.where("data_ok").withColumnRenamed("session", "day")
    return rows.withColumn("session", F.row_number().over(by("universe", order="day")))


def carried(days: DataFrame, bench: DataFrame) -> DataFrame:
    """The benchmark on days (universe, session, date), carried forward over days without a value; values on other dates are not used."""
    rows = days.select("universe", "session", "date").join(bench.select("universe", "date", "px"), ["universe", "date"], "left")
    return rows.withColumn("px", filled(F.col("px"), by("universe"))).select("universe", "session", "date", "px")


def cell(comp: DataFrame, bench: DataFrame, threshold: int, horizon: tuple[str, int], draws: int = 2000, gap: int = 63) -> DataFrame:
    """One cell of each universe's study, with its clusters and whether its median is over the baseline's."""
    name, h = horizon
    signal, fwd = E.lagged(comp, bench), E.forward(bench, {name: h})
    cond, base = E.conditional(signal, fwd, bench, (threshold,)), E.baseline(fwd, draws)
    dates = signal.where(F.col("event") & (F.col("score") >= threshold)).join(bench.select("universe", "session", "date"), ["universe", "session"])
    groups = E.clusters(dates.select("universe", "date"), ["universe"], gap)
    out = cond.join(base, ["universe", "horizon"], "left").join(groups, "universe", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        "universe", "n", F.coalesce("clusters", F.lit(0)).alias("clusters"), "win_rate", "base_win_rate", no(F.col("win_rate") > F.col("base_win_hi")).alias("win_beyond_noise"),
        "median_ret", "base_median_ret", no(F.col("median_ret") > F.col("base_ret_hi")).alias("ret_beyond_noise"),
        ((F.col("median_ret") - F.col("base_median_ret")) * 100).alias("median_lift_pp"), no(F.col("median_ret") > F.col("base_median_ret")).alias("replicates"),
    )


def tilt_legs(comp: DataFrame, legs: DataFrame, variant: tuple[str, float, int], p: TiltParams = TiltParams()) -> DataFrame:
    """(universe, sharpe, base_sharpe, sharpe_delta, n_tilts): the tilted backtest against the untilted one, both in one job. legs (universe, session, date, px, bond_ret)."""
    w = by("universe")
    signal = comp.select("universe", "session", F.lag("event").over(w).alias("event"), F.lag("n_dimensions").over(w).alias("score"))
    rows = PF.tilt(signal, *variant, ["universe"]).select("universe", "session", "tilt").join(legs, ["universe", "session"])
    both = rows.select("universe", "session", "date", "px", "bond_ret", F.inline(F.array(F.struct(F.lit("signal").alias("leg"), F.col("tilt")), F.struct(F.lit("base").alias("leg"), F.lit(0.0).alias("tilt")))))
    m = PF.metrics(PF.backtest(both, ["universe", "leg"], p), ["universe", "leg"], p)
    sharpe = m.groupBy("universe").agg(F.max(F.when(F.col("leg") == "signal", F.col("sharpe"))).alias("sharpe"), F.max(F.when(F.col("leg") == "base", F.col("sharpe"))).alias("base_sharpe"))
    out = sharpe.join(PF.tilt_stats(rows, ["universe"]), "universe")
    return out.select("universe", "sharpe", "base_sharpe", (F.col("sharpe") - F.col("base_sharpe")).alias("sharpe_delta"), "n_tilts")


def gate(cells: DataFrame) -> DataFrame:
    """cells (universe, mode, replicates): REPLICATED where the cell replicates in at least one universe with sized thresholds; these universes, sorted."""
    good = F.sort_array(F.collect_set(F.when(F.col("replicates") & (F.col("mode") == "sized"), F.col("universe"))))
    return cells.agg(good.alias("replicated_in")).select("replicated_in", F.when(F.size("replicated_in") > 0, "REPLICATED").otherwise("NOT REPLICATED").alias("verdict"))


def silent_period(fired: DataFrame, start: str, end: str, detector: str = "zweig", gap: int = 21, few: int = 10) -> DataFrame:
    """fired (universe, date, detector): the detector's days and clusters between two dates, and whether these are few; universes without a fire have none."""
    days = fired.select("universe").distinct()
    inside = fired.where((F.col("detector") == detector) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    found = inside.groupBy("universe").agg(F.count("*").alias("fire_days")).join(E.clusters(inside.select("universe", "date"), ["universe"], gap), "universe")
    out = days.join(found, "universe", "left").select("universe", F.coalesce("fire_days", F.lit(0)).alias("fire_days"), F.coalesce("clusters", F.lit(0)).alias("episodes"))
    return out.withColumn("verdict", F.when(F.col("episodes") < few, "CONSISTENT").otherwise("LOOSER"))


def reconcile_three(filed: DataFrame, clean: DataFrame, candidate: DataFrame, horizons=("6m", "12m")) -> DataFrame:
    """Study tables (universe, threshold, horizon, n, win_rate, median_ret) of the filed record, of it without burn-in events, and of another layer: what of the change each step makes, and whether an erratum is due."""
    keys = ["universe", "threshold", "horizon"]
    named = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in ("n", "win_rate", "median_ret")])
    j = named(filed, "a").join(named(candidate, "c"), keys).join(named(clean, "b"), keys, "left").where(F.col("horizon").isin(*horizons))
    pp = lambda x, y: (F.col(x) - F.col(y)) * 100
    j = j.select(*keys, "a_n", "b_n", "c_n", pp("b_win_rate", "a_win_rate").alias("burn_in_pp"), pp("c_win_rate", "b_win_rate").alias("layer_pp"), pp("c_win_rate", "a_win_rate").alias("win_pp"), pp("c_median_ret", "a_median_ret").alias("median_pp"))
    due = F.coalesce(F.abs("win_pp") > 2, F.lit(False)) | F.coalesce(F.abs("median_pp") > 1, F.lit(False)) | (F.abs(F.col("c_n") - F.col("a_n")) > 2)
    return j.withColumn("erratum", due)


def bond_proxy(proxy: DataFrame, fund: DataFrame, least: int = 250, year: int = 252) -> DataFrame:
    """proxy, fund (universe, date, ret): correlation, compounded yearly returns and volatilities over joint dates; too few give only their number."""
    j = proxy.select("universe", "date", F.col("ret").alias("p")).join(fund.select("universe", "date", F.col("ret").alias("f")), ["universe", "date"]).na.drop()
    enough = lambda c: F.when(F.count("*") >= least, c)
    ann = lambda c: F.pow(F.product(1 + F.col(c)), F.lit(float(year)) / F.count("*")) - 1
    vol = lambda c: F.stddev_samp(c) * F.sqrt(F.lit(float(year)))
    return j.groupBy("universe").agg(
        F.count("*").alias("overlap_days"), F.min("date").alias("overlap_start"), (F.count("*") >= least).alias("available"), enough(F.corr("p", "f")).alias("correlation"), enough(ann("p")).alias("proxy_return"),
        enough(ann("f")).alias("fund_return"), enough((ann("p") - ann("f")) * 100).alias("gap_pp"), enough(vol("p")).alias("proxy_vol"), enough(vol("f")).alias("fund_vol"),
    )


def level_contrast(events: DataFrame, fwd: DataFrame, base: DataFrame) -> DataFrame:
    """Forward statistics from the session after each event (universe, kind, session), by kind and horizon, against the baseline; a row for every kind and horizon."""
    rows = events.select("universe", "kind", (F.col("session") + 1).alias("session")).join(fwd.where("fwd is not null"), ["universe", "session"])
    stats = rows.groupBy("universe", "kind", "horizon").agg(F.count("*").alias("n"), F.avg((F.col("fwd") > 0).cast("double")).alias("win_rate"), F.percentile("fwd", F.lit(0.5)).alias("median_ret"))
    grid = events.select("universe", "kind").distinct().join(base, "universe")
    out = grid.join(stats, ["universe", "kind", "horizon"], "left")
    return out.select("universe", "kind", "horizon", F.coalesce("n", F.lit(0)).alias("n"), "win_rate", "median_ret", "base_win_rate", "base_median_ret", (F.col("win_rate") - F.col("base_win_rate")).alias("win_lift"), F.coalesce(F.col("win_rate") > F.col("base_win_hi"), F.lit(False)).alias("win_beyond_noise"))
