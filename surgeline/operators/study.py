"""Event studies: lagged forward returns by score against a block bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgeline.functions.series import by
from surgeline.params import HORIZONS, THRESHOLDS


def forward(bench: DataFrame, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """bench (universe, session, px) to rows (universe, session, horizon, h, fwd): the return over the next h sessions, null where the series ends first. One window serves all horizons."""
    w = by("universe")
    cells = F.array(*[F.struct(F.lit(name).alias("horizon"), F.lit(h).alias("h"), (F.lead("px", h).over(w) / F.col("px") - 1.0).alias("fwd")) for name, h in horizons.items()])
    return bench.select("universe", "session", cells.alias("cells")).select("universe", "session", F.inline("cells"))


def worst_falls(bench: DataFrame, lengths: list[int]) -> DataFrame:
    """bench (universe, session, px) with mdd_<n> for each length: the worst fall from a peak over that many sessions from this one on; null where the series ends first.

    Stretches of 1, 2, 4, ... sessions have their largest and smallest price and their worst
    fall; two that follow each other make one, where the fall may also be from the first's
    peak to the second's low. A length is made of the powers of two in it, so a row costs about log2 of it.
    """
    w = by("universe")

    def later(c: str, n: int):
        x = F.col(c)
        return F.lead(x, n).over(w) if n else x

    def merged(first, second):
        (top, low, fall), (top2, low2, fall2) = first, second
        return F.greatest(top, top2), F.least(low, low2), F.least(fall, fall2, low2 / top - 1.0)

    cols = ["universe", "session"]
    rows = bench.select(*cols, F.col("px").alias("top0"), F.col("px").alias("low0"), F.lit(0.0).alias("fall0"))
    step = lambda k, at: tuple(later(f"{c}{k}", at) for c in ("top", "low", "fall"))
    for k in range(max(lengths).bit_length() - 1):
        new = merged(step(k, 0), step(k, 1 << k))
        rows = rows.select("*", *[x.alias(f"{c}{k + 1}") for c, x in zip(("top", "low", "fall"), new)])
    for n in lengths:
        state, at = None, 0
        for k in range(n.bit_length()):
            if n >> k & 1:
                state = step(k, at) if state is None else merged(state, step(k, at))
                at += 1 << k
        rows = rows.withColumn(f"mdd_{n}", F.when(F.lead("session", n - 1).over(w).isNotNull(), state[2]))
    return rows.select(*cols, *[f"mdd_{n}" for n in lengths])


def drawdowns(rows: DataFrame, bench: DataFrame, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """rows (universe, session, horizon, h) to (universe, session, horizon, mdd): the worst fall from a peak over the next h sessions; rows whose path the series cuts short have none. horizons names all that rows may have."""
    falls = worst_falls(bench, sorted({h + 1 for h in horizons.values()}))
    each = F.array(*[F.struct(F.lit(name).alias("horizon"), F.col(f"mdd_{h + 1}").alias("mdd")) for name, h in horizons.items()])
    falls = falls.select("universe", "session", F.inline(each)).where("mdd is not null")
    return rows.select("universe", "session", "horizon").join(falls, ["universe", "session", "horizon"])


def in_window(comp: DataFrame) -> DataFrame:
    """Sessions from the first to the last with data_ok; days between stay, whatever they are."""
    return comp.join(comp.where("data_ok").groupBy("universe").agg(F.min("session").alias("lo"), F.max("session").alias("hi")), "universe").where("session between lo and hi").drop("lo", "hi")


def lagged(comp: DataFrame, bench: DataFrame) -> DataFrame:
    """The signal known one session before, on the benchmark's sessions: (universe, session, score, event)."""
    rows = bench.select("universe", "session").join(comp.select("universe", "session", "n_dimensions", "event"), ["universe", "session"], "left")
    w = by("universe")
    return rows.select("universe", "session", F.lag("n_dimensions").over(w).alias("score"), F.coalesce(F.lag("event").over(w), F.lit(False)).alias("event"))


def selections(signal: DataFrame, fwd: DataFrame, thresholds=THRESHOLDS, events_only: bool = True) -> DataFrame:
    """Sessions that count for each threshold and horizon, with their forward return."""
    rows = signal.where("event" if events_only else "true").join(fwd.where("fwd is not null"), ["universe", "session"])
    each = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("score") >= t)
    return rows.select("universe", "session", "horizon", "h", "fwd", F.explode(each).alias("threshold"))


def conditional(signal: DataFrame, fwd: DataFrame, bench: DataFrame, thresholds=THRESHOLDS, events_only: bool = True, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """A row for every threshold and horizon, empty ones too: n, win_rate, mean, median, percentiles and the median worst fall."""
    q = lambda p: F.percentile("fwd", F.lit(p))
    chosen = selections(signal, fwd, thresholds, events_only)
    falls = drawdowns(chosen.select("universe", "session", "horizon", "h").distinct(), bench, horizons)
    stats = chosen.join(falls, ["universe", "session", "horizon"], "left").groupBy("universe", "threshold", "horizon").agg(
        F.count("*").alias("n"), F.avg((F.col("fwd") > 0).cast("double")).alias("win_rate"), q(0.5).alias("median_ret"), F.avg("fwd").alias("mean_ret"),
        q(0.10).alias("p10"), q(0.25).alias("p25"), q(0.75).alias("p75"), q(0.90).alias("p90"), F.median("mdd").alias("median_max_dd"),
    )
    grid = fwd.groupBy("universe", "horizon").agg(F.first("h")).select("universe", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"), "horizon")
    return grid.join(stats, ["universe", "threshold", "horizon"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def start_of(n_starts, *keys):
    """A deterministic draw from 0 .. n_starts - 1 for integer keys (a multiplicative generator, the same in SQL)."""
    x = F.lit(12345).cast("long")
    for k in keys:
        x = (x * 48271 + k.cast("long") * 16807 + 7) % F.lit(2147483647).cast("long")
    x = (x * 48271) % F.lit(2147483647).cast("long")
    m = F.lit(2147483647).cast("long")
    return ((x * n_starts - (x * n_starts) % m) / m).cast("long")


def drawn_starts(series: DataFrame, keys: list[str], draws: int, block: int, seed: list) -> DataFrame:
    """series (keys, n, ...), a row for each key, to a row for each draw, with starts, the first places (from 0) of its moving blocks: as many as fit into n values, at least one; the last start is never drawn.

    Draws are dealt out in parts, each with the series once, so nothing is a row for each sampled value.
    """
    per = 32
    parts = series.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // per))))
    parts = parts.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "part_")
    each = parts.withColumn("draw", F.explode(F.sequence(F.col("part_") * per, F.least((F.col("part_") + 1) * per, F.lit(draws)) - 1))).drop("part_")
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"n div {block}"), F.lit(1)) - 1)
    return each.withColumn("starts", F.transform(blocks, lambda b: start_of(F.greatest(F.col("n") - block, F.lit(1)), *seed, F.col("draw"), b)))


def _middle(values):
    """The median of an array."""
    v, n = F.array_sort(values), F.size(values)
    low, high = F.get(v, F.floor((n - 1) / 2).cast("int")), F.get(v, F.floor(n / 2).cast("int"))
    return low + (high - low) * 0.5


def bootstrap(fwd: DataFrame, draws: int, block: int, seed: int = 42) -> DataFrame:
    """(universe, horizon, draw, win, med): share of gains and median over the values of each draw's blocks, a row for each draw.

    A block's gains are the difference of two running counts; its values, a slice of the series.
    """
    rows = fwd.where("fwd is not null").select("universe", "horizon", "h", F.struct("session", "fwd").alias("v"))
    series = rows.groupBy("universe", "horizon").agg(F.first("h").alias("h"), F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list("v")), lambda x: x["fwd"]).alias("series"))  # a value for each session
    gains = F.aggregate("series", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + (x > 0).cast("int")))
    each = drawn_starts(series.withColumn("gains", gains), ["universe", "horizon"], draws, block, [F.lit(seed), F.col("h")])
    end = lambda s: F.least(s + block, F.col("n")).cast("int")
    won = F.aggregate("starts", F.lit(0), lambda a, s: a + F.get("gains", end(s)) - F.get("gains", s.cast("int")))
    values = F.flatten(F.transform("starts", lambda s: F.slice("series", s.cast("int") + 1, F.lit(block))))
    each = each.select("universe", "horizon", "draw", won.alias("won"), values.alias("values"))
    return each.select("universe", "horizon", "draw", (F.col("won") / F.size("values")).alias("win"), _middle(F.col("values")).alias("med"))


def baseline(fwd: DataFrame, draws: int = 2000, block: int = 21, seed: int = 42) -> DataFrame:
    """What any session gives: medians and 5 % and 95 % points of win rate and median over draws."""
    each = bootstrap(fwd, draws, block, seed)
    q = lambda c, p: F.percentile(c, F.lit(p))
    out = each.groupBy("universe", "horizon").agg(
        q("win", 0.5).alias("base_win_rate"), q("win", 0.05).alias("base_win_lo"), q("win", 0.95).alias("base_win_hi"),
        q("med", 0.5).alias("base_median_ret"), q("med", 0.05).alias("base_ret_lo"), q("med", 0.95).alias("base_ret_hi"),
    )
    return out.join(fwd.groupBy("universe", "horizon").agg(F.count("fwd").alias("n_total")), ["universe", "horizon"])


def lift(cond: DataFrame, base: DataFrame) -> DataFrame:
    out = cond.join(base, ["universe", "horizon"], "left")
    return out.select(
        "universe", "threshold", "horizon", "n", (F.col("win_rate") - F.col("base_win_rate")).alias("win_lift"), (F.col("median_ret") - F.col("base_median_ret")).alias("ret_lift"),
        F.coalesce(F.col("win_rate") > F.col("base_win_hi"), F.lit(False)).alias("win_beyond_noise"), F.coalesce(F.col("median_ret") > F.col("base_ret_hi"), F.lit(False)).alias("ret_beyond_noise"),
    )


def decision(lifted: DataFrame, clusters: DataFrame, threshold: int = 3, horizon: str = "6m", few: int = 10) -> DataFrame:
    """PASS where both legs of one cell are beyond noise; a caveat where any leg is and the events form few clusters."""
    cell = lifted.where((F.col("threshold") == threshold) & (F.col("horizon") == horizon)).join(clusters.where(F.col("threshold") == threshold).select("universe", "clusters"), "universe", "left")
    both, some = F.col("win_beyond_noise") & F.col("ret_beyond_noise"), F.col("win_beyond_noise") | F.col("ret_beyond_noise")
    return cell.select("universe", F.when(both, "PASS").otherwise("FAIL").alias("verdict"), (some & (F.coalesce("clusters", F.lit(0)) < few)).alias("caveat"))


def clusters(dates: DataFrame, keys: list[str], gap: int = 63) -> DataFrame:
    """(keys, clusters): groups of dates with more than gap calendar days between them."""
    w = Window.partitionBy(*keys).orderBy("date")
    new = F.coalesce((F.datediff("date", F.lag("date").over(w)) > gap).cast("int"), F.lit(1))
    return dates.withColumn("new", new).groupBy(*keys).agg(F.sum("new").alias("clusters"))


def monotonic(lifted: DataFrame, horizon: str = "6m") -> DataFrame:
    """Spearman's rank correlation of threshold and win lift, from three cells with events; ties get mean ranks."""
    rows = lifted.where((F.col("horizon") == horizon) & (F.col("n") > 0) & F.col("win_lift").isNotNull())

    def rank(c):
        w = Window.partitionBy("universe").orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy("universe", c)) - 1) / 2.0

    ranks = rows.select("universe", rank("threshold").alias("a"), rank("win_lift").alias("b"))
    return ranks.groupBy("universe").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("a", "b")).alias("rho"))


def last_signal(comp: DataFrame, bench: DataFrame, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """The last event with a dimension on, its anchor (the next session), and the returns since then that are known."""
    at = comp.where("event and n_dimensions >= 1").groupBy("universe").agg(F.max_by(F.struct("session", "date", "n_dimensions"), "session").alias("e"))
    at = at.select("universe", F.col("e.date").alias("event_date"), F.col("e.n_dimensions").alias("n_dimensions"), (F.col("e.session") + 1).alias("anchor"))
    rows = bench.join(at, "universe").where("session >= anchor")
    first = F.max(F.when(F.col("session") == F.col("anchor"), F.col("px")))
    then = [(F.max(F.when(F.col("session") == F.col("anchor") + h, F.col("px"))) / first - 1.0).alias(f"ret_{k}") for k, h in horizons.items()]
    return rows.groupBy("universe", "event_date", "n_dimensions", "anchor").agg((F.max_by("px", "session") / first - 1.0).alias("ret_to_date"), F.count("*").alias("sessions"), *then)


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two study tables cell by cell; an erratum is due for 2 points of win rate, 1 of median, or more than 2 events."""
    b = new.select("universe", "threshold", "horizon", *[F.col(c).alias(f"new_{c}") for c in ("n", "win_rate", "median_ret")])
    out = old.join(b, ["universe", "threshold", "horizon"])
    dn, dw, dm = F.col("new_n") - F.col("n"), F.col("new_win_rate") - F.col("win_rate"), F.col("new_median_ret") - F.col("median_ret")
    due = F.coalesce(F.abs(dw) > 0.02, F.lit(False)) | F.coalesce(F.abs(dm) > 0.01, F.lit(False)) | (F.abs(dn) > 2)
    return out.select("universe", "threshold", "horizon", dn.alias("delta_n"), dw.alias("delta_win"), dm.alias("delta_median"), due.alias("erratum"))


def study(bench: DataFrame, signal: DataFrame, fwd: DataFrame, draws: int = 2000, thresholds=THRESHOLDS, gap: int = 63) -> DataFrame:
    """Every cell's lift over the baseline, with the clusters of its threshold's events (which need no known return)."""
    lifted = lift(conditional(signal, fwd, bench, thresholds), baseline(fwd, draws))
    rows = signal.where("event").join(bench.select("universe", "session", "date"), ["universe", "session"])
    each = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("score") >= t)
    groups = clusters(rows.select("universe", "date", F.explode(each).alias("threshold")), ["universe", "threshold"], gap)
    return lifted.join(groups, ["universe", "threshold"], "left").withColumn("clusters", F.coalesce("clusters", F.lit(0)))
