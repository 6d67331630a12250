"""Cross-sectional breadth of a panel by session, and the thrust detectors on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgeline.functions.series import any_within, block_extremes, by, crossed_up, ema, rolling_sum, trailing
from surgeline.params import ThrustParams

COUNTS = ["advances", "declines", "valid_count", "above_count", "ma_valid_count", "new_highs", "new_lows", "hl_valid_count", "up_volume", "total_volume"]


def breadth(panel: DataFrame, sessions: DataFrame, p: ThrustParams = ThrustParams()) -> DataFrame:
    """(universe, session, date) with COUNTS, pct_above and up_volume_ratio, a row for every session.

    panel (universe, session, ticker, px, volume) may have gaps. A ticker's
    unbroken stretches are told apart first, so a window is full only inside one
    stretch, and one shuffle by ticker serves all windows. Integer prices use running sums; others a sliding sum.
    """
    keys = ["universe", "ticker"]
    rows = panel.select(*keys, "session", "px", "volume").withColumn("run", F.col("session") - F.row_number().over(by(*keys)))
    keys = [*keys, "run"]
    w = by(*keys)
    rows = rows.withColumn("pos", F.row_number().over(w)).withColumn("prev", F.lag("px").over(w))
    whole = dict(panel.dtypes)["px"] in ("int", "bigint")
    total = rolling_sum(F.col("px"), w, p.ma_window) if whole else F.when(F.col("pos") >= p.ma_window, F.sum("px").over(trailing(w, p.ma_window)))
    rows = rows.withColumn("ma_sum", total)
    rows = block_extremes(rows, keys, "px", p.high_low_window, "high", "low")
    up, valid = F.col("px") > F.col("prev"), F.col("prev").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    daily = rows.groupBy("universe", "session").agg(
        n(up).alias("advances"), n(F.col("px") < F.col("prev")).alias("declines"), n(valid).alias("valid_count"),
        n(F.col("px") * p.ma_window > F.col("ma_sum")).alias("above_count"), F.count("ma_sum").alias("ma_valid_count"),
        n(F.col("px") >= F.col("high")).alias("new_highs"), n(F.col("px") <= F.col("low")).alias("new_lows"), F.count("high").alias("hl_valid_count"),
        F.sum(F.when(up, F.col("volume")).otherwise(0)).alias("up_volume"), F.sum(F.when(valid, F.col("volume")).otherwise(0)).alias("total_volume"),
    )
    out = sessions.join(daily, ["universe", "session"], "left").select("universe", "session", "date", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])
    return out.withColumn("pct_above", F.col("above_count") / F.nullif("ma_valid_count", F.lit(0))).withColumn("up_volume_ratio", F.col("up_volume") / F.nullif("total_volume", F.lit(0)))


def lines(daily: DataFrame, p: ThrustParams = ThrustParams()) -> DataFrame:
    """Adds the indicator lines: ad_ratio, net, zweig_line, deemer_ratio, mcc, high_ratio, net_highs."""
    adv, dec = F.col("advances"), F.col("declines")
    df = daily.withColumn("ad_ratio", adv / F.nullif(adv + dec, F.lit(0))).withColumn("net", adv - dec)
    df = ema(df, ["universe"], {"zweig_line": ("ad_ratio", p.zweig_span), "fast": ("net", p.mcc_fast), "slow": ("net", p.mcc_slow)})
    w = by("universe")
    deemer = rolling_sum(adv, w, p.deemer_window) / F.nullif(rolling_sum(dec, w, p.deemer_window), F.lit(0))
    nh, nl = F.col("new_highs"), F.col("new_lows")
    return df.select("*", deemer.alias("deemer_ratio"), (F.col("fast") - F.col("slow")).alias("mcc"), (nh / F.nullif(nh + nl, F.lit(0))).alias("high_ratio"), (nh - nl).alias("net_highs"))


def detectors(line_rows: DataFrame, p: ThrustParams = ThrustParams()) -> DataFrame:
    """Adds the flags of the sub-conditions and of the four dimensions d1 to d4. The thresholds that are counts are scaled by the column scale where there is one, else by the parameter."""
    w = by("universe")
    scale = F.col("scale") if "scale" in line_rows.columns else F.lit(p.scale)
    no = lambda c: F.coalesce(c, F.lit(False))
    df = line_rows.select(
        "*",
        crossed_up(F.col("zweig_line"), p.zweig_low, p.zweig_high, w, p.zweig_span).alias("zweig"),
        no(F.col("deemer_ratio") > p.deemer_ratio).alias("deemer"),
        (no(F.col("mcc") > 0) & any_within(no(F.col("mcc") < p.mcc_floor * scale), w, p.mcc_window)).alias("mcclellan"),
        crossed_up(F.col("pct_above"), p.pct_low, p.pct_high, w, p.pct_window).alias("d2"),
        crossed_up(F.col("high_ratio"), p.ratio_low, p.ratio_high, w, p.ratio_window).alias("nhnl_ratio"),
        (no(F.col("net_highs") > p.net_highs * scale) & any_within(no(F.col("net_highs") < 0), w, p.net_window)).alias("nhnl_net"),
        any_within(no(F.col("up_volume_ratio") > p.up_volume), w, p.up_volume_window).alias("d4"),
    )
    return df.withColumn("d1", F.col("zweig") | F.col("deemer") | F.col("mcclellan")).withColumn("d3", F.col("nhnl_ratio") | F.col("nhnl_net"))


def composite(flags: DataFrame, p: ThrustParams = ThrustParams()) -> DataFrame:
    """Adds what the memory keeps: d1_on to d4_on, n_dimensions, score, event, burn_in, data_ok. An event is a rise in the number of dimensions."""
    w = by("universe")
    df = flags.select("*", *[any_within(F.col(f"d{k}"), w, p.memory).alias(f"d{k}_on") for k in (1, 2, 3, 4)])
    on = [F.col(f"d{k}_on").cast("int") for k in (1, 2, 3, 4)]
    df = df.withColumn("n_dimensions", on[0] + on[1] + on[2] + on[3]).withColumn("score", sum((o * x for o, x in zip(on[1:], p.weights[1:])), on[0] * p.weights[0]))
    df = df.withColumn("event", F.col("n_dimensions") > F.lag("n_dimensions", 1, 0).over(w))
    df = df.withColumn("burn_in", (F.col("ma_valid_count") < p.min_valid) | (F.col("hl_valid_count") < p.min_valid))
    return df.withColumn("data_ok", (F.col("valid_count") >= p.min_valid) & ~F.col("burn_in"))


def thrust(panel: DataFrame, sessions: DataFrame, p: ThrustParams = ThrustParams()) -> DataFrame:
    """The whole chain from a panel to the composite."""
    return composite(detectors(lines(breadth(panel, sessions, p), p), p), p)


def latest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each universe's last session."""
    return df.groupBy("universe").agg(F.max_by(F.struct("session", "date", *columns), "session").alias("x")).select("universe", "x.*")


def scale_of(daily: DataFrame, nominal: int = 500) -> DataFrame:
    """(universe, scale): median members of active days against the nominal universe; count thresholds are multiplied by it."""
    return daily.where("valid_count > 0").groupBy("universe").agg((F.median("valid_count") / nominal).alias("scale"))
