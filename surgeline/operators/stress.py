"""Stress tests: regressions, quartile events, narrowness, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgeline.functions.chains import cut, islands, reached, successors
from surgeline.functions.percentiles import percentiles
from surgeline.functions.series import by, running


def regressions(frame: DataFrame, fwd: DataFrame) -> DataFrame:
    """Slope on the standardised predictor and R2, by horizon, for the level and its 21-session change, one session late; and the slope over every h-th row, standardised again.

    frame (universe, session, level); fwd (universe, session, horizon, h, fwd).
    """
    w = by("universe")
    x = frame.withColumn("change", F.col("level") - F.lag("level", 21).over(w)).select("universe", "session", F.lag("level").over(w).alias("level"), F.lag("change").over(w).alias("change_21d"))
    rows = x.unpivot(["universe", "session"], ["level", "change_21d"], "predictor", "x").where("x is not null").join(fwd.where("fwd is not null and horizon <> '1w'"), ["universe", "session"])
    keys = ["universe", "horizon", "predictor"]
    rows = rows.withColumn("i", F.row_number().over(by(*keys)) - 1)
    slope = lambda c: F.covar_pop(c, "fwd") / F.nullif(F.stddev_pop(c), F.lit(0.0))
    every = F.when(F.col("i") % F.col("h") == 0, F.col("x"))
    n_no = F.count(every)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), slope("x").alias("slope_std"), F.pow(F.corr("x", "fwd"), 2).alias("r2"), n_no.alias("n_nonoverlap"), F.when(n_no > 3, F.covar_pop(every, F.when(every.isNotNull(), F.col("fwd"))) / F.nullif(F.stddev_pop(every), F.lit(0.0))).alias("slope_nonoverlap"))


def bootstrap_slopes(rows: DataFrame, draws: int, block: int, seed: int = 42) -> DataFrame:
    """rows (key, i, x, y), i from 0: the median and the 5 % and 95 % points of the standardised slope over paired block draws; significant where these exclude 0.

    A block's sums are differences of running ones, of values less their mean, so a draw looks two places of each block up.
    """
    from surgeline.operators.study import drawn_starts

    mean = Window.partitionBy("key")
    x, y = F.col("x") - F.avg("x").over(mean), F.col("y") - F.avg("y").over(mean)
    cells = rows.select("key", "i", x.alias("x"), y.alias("y"))
    w = running(by("key", order="i"))
    names = {"sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y")}
    sums = cells.select("key", "i", *[F.sum(v).over(w).alias(c) for c, v in names.items()])
    series = sums.groupBy("key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("i", *names))).alias("s"))  # sums for each session
    series = series.select("key", "n", *[F.concat(F.array(F.lit(0.0)), F.col(f"s.{c}")).alias(c) for c in names])
    each = drawn_starts(series, ["key"], draws, block, [F.lit(seed)])
    end = lambda s: F.least(s + block, F.col("n")).cast("int")
    added = lambda c: lambda a, s: a + F.get(c, end(s)) - F.get(c, s.cast("int"))
    total = {c: F.aggregate("starts", F.lit(0.0), added(c)) for c in names}
    size = F.aggregate("starts", F.lit(0).cast("long"), lambda a, s: a + end(s) - s)
    each = each.select("key", size.alias("m"), *[t.alias(c) for c, t in total.items()])
    m = F.col("m")
    spread = F.sqrt(F.greatest(F.col("sxx") / m - F.pow(F.col("sx") / m, 2), F.lit(0.0)))
    each = each.select("key", ((F.col("sxy") / m - F.col("sx") / m * F.col("sy") / m) / F.nullif(spread, F.lit(0.0))).alias("slope"))
    q = lambda p: F.percentile("slope", F.lit(p))
    out = each.groupBy("key").agg(q(0.5).alias("slope_med"), q(0.05).alias("slope_lo5"), q(0.95).alias("slope_hi95"))
    return out.withColumn("excludes_zero", (F.col("slope_lo5") > 0) | (F.col("slope_hi95") < 0))


def declustered(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Greedy: an event stays if it is more than gap sessions after the last that stayed. rows (keys, i); repeated events count once.

    An event's successor, if it stays, is the first more than gap later. The first of each
    stretch without such a gap stays in any case; what its successors lead to stays, by pointer jumping.
    """
    places = cut(islands(cut(rows.select(*keys, "i").where("i is not null").distinct()), keys, "i", gap))
    return reached(places.where("i = island"), successors(places, keys, "i", gap), keys, "i")


def quartile_events(frame: DataFrame, gap: int = 21) -> DataFrame:
    """(universe, kind, session): falls under the first quartile and rises over the third of the whole sample, greedily thinned."""
    w = by("universe")
    frame = cut(frame.select("universe", "session", "level"))
    q = percentiles(frame, ["universe"], {"lo": ("level", 0.25), "hi": ("level", 0.75)})
    rows = frame.select("universe", "session", "level", F.lag("level").over(w).alias("before")).join(q, "universe")
    down, up = (F.col("level") < F.col("lo")) & (F.col("lo") <= F.col("before")), (F.col("level") > F.col("hi")) & (F.col("hi") >= F.col("before"))
    events = rows.select("universe", F.explode(F.filter(F.array(F.when(down, "washout_entry"), F.when(up, "strength_entry")), lambda k: k.isNotNull())).alias("kind"), F.col("session").alias("i"))
    return declustered(events, ["universe", "kind"], gap).withColumnRenamed("i", "session")


def event_contrast(events: DataFrame, fwd: DataFrame) -> DataFrame:
    """Forward statistics from the session after each event, by kind and horizon."""
    rows = events.select("universe", "kind", (F.col("session") + 1).alias("session")).join(fwd.where("fwd is not null"), ["universe", "session"])
    return rows.groupBy("universe", "kind", "horizon").agg(F.count("*").alias("n"), F.avg((F.col("fwd") > 0).cast("double")).alias("win_rate"), F.percentile("fwd", F.lit(0.5)).alias("median_ret"))


def month_ends(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(month, date, columns): the last row of each calendar month."""
    return rows.groupBy(F.trunc("date", "MM").cast("date").alias("month")).agg(F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in columns])


def narrowness(monthly: DataFrame, thresholds=(0, 2, 5)) -> DataFrame:
    """monthly (month, a, b): months whose 12-month return of a beats b's by more than threshold points: (threshold, month, valid months only, diff, fwd12, flagged)."""
    w = Window.partitionBy(F.lit(1).cast("string")).orderBy("month")  # a row for each month
    rows = monthly.select("month", ((F.col("a") / F.lag("a", 12).over(w) - F.col("b") / F.lag("b", 12).over(w)) * 100).alias("diff"), (F.lead("a", 12).over(w) / F.col("a") - 1.0).alias("fwd12"))
    valid = rows.where("diff is not null and fwd12 is not null")
    return valid.select(F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"), "month", "diff", "fwd12").withColumn("flagged", F.col("diff") > F.col("threshold"))


def episodes(rows: DataFrame, keys: list[str], order: str, flag: str, value: str) -> DataFrame:
    """Unbroken stretches of the flag: first, last, length, the value's mean and share above 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("at", F.row_number().over(w)).where(flag)
    marked = marked.withColumn("island", F.col("at") - F.row_number().over(w))
    return marked.groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"), F.avg(value).alias("mean_value"), F.avg((F.col(value) > 0).cast("double")).alias("share_pos")).drop("island")


def fires(flag_rows: DataFrame, columns: list[str], gate: str = "data_ok") -> DataFrame:
    """(universe, session, date, detector) for each flag that holds on a day that passes the gate."""
    on = F.array(*[F.when(F.col(c), F.lit(c)) for c in columns])
    return flag_rows.where(gate).select("universe", "session", "date", F.explode(F.filter(on, lambda x: x.isNotNull())).alias("detector"))


def anchor_hits(fired: DataFrame, anchors: DataFrame, days: int = 5) -> DataFrame:
    """anchors (anchor date, kind 'day' or 'month'): the number of fires within days calendar days, or in the month; none is 0.

    A day anchor is spread over its days first, so both kinds are equal joins.
    """
    spread = anchors.select("anchor", "kind", F.when(F.col("kind") == "day", F.sequence(F.date_sub("anchor", days), F.date_add("anchor", days))).otherwise(F.sequence(F.trunc("anchor", "MM").cast("date"), F.last_day("anchor"))).alias("d")).select("anchor", "kind", F.explode("d").alias("date"))
    hits = spread.join(fired, "date").groupBy("anchor", "kind").agg(F.count("*").alias("hits"), F.count_distinct("detector").alias("detectors"))
    return anchors.join(hits, ["anchor", "kind"], "left").select("anchor", "kind", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("detectors", F.lit(0)).alias("detectors"), F.col("hits").isNotNull().alias("match"))
