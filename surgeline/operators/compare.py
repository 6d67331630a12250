"""Series against series: statistics of pairs, event matching, mismatches at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgeline.functions.chains import cut, islands
from surgeline.functions.percentiles import percentiles
from surgeline.functions.series import by, edges, ema, rolling_sum
from surgeline.params import ThrustParams


def pair_stats(a: DataFrame, b: DataFrame, least: int = 250) -> DataFrame:
    """a, b (key, date, value): correlation of levels and of changes, differences and scale over joint dates; too few give only their number."""
    w = Window.partitionBy("key").orderBy("date")
    j = a.select("key", "date", F.col("value").alias("x")).join(b.select("key", "date", F.col("value").alias("y")), ["key", "date"]).na.drop()
    j = j.select("*", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"))
    j = cut(j.select("*", (F.col("x") - F.col("y")).alias("diff"), F.abs(F.col("x") - F.col("y")).alias("gap"), F.abs("x").alias("ax"), F.abs("y").alias("ay")))
    enough = lambda c: F.when(F.col("n") >= least, c)
    sums = j.groupBy("key").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr_level"), F.corr("dx", "dy").alias("corr_change"))
    points = percentiles(j, ["key"], {"median_diff": ("diff", 0.5), "p95_abs_diff": ("gap", 0.95), "mx": ("ax", 0.5), "my": ("ay", 0.5)})
    out = sums.join(points, "key")
    return out.select("key", "n", *[enough(F.col(c)).alias(c) for c in ("corr_level", "corr_change", "median_diff", "p95_abs_diff")], enough(F.col("my") / F.nullif(F.col("mx"), F.lit(0.0))).alias("scale_ratio"))


def in_units(series: DataFrame) -> DataFrame:
    """Percentages become shares: where a series' largest value is over 1.5, all go by 100."""
    top = series.groupBy("key").agg(F.max("value").alias("top"))
    return series.join(top, "key").withColumn("value", F.when(F.col("top") > 1.5, F.col("value") / 100.0).otherwise(F.col("value"))).drop("top")


def flag_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key", "date", F.col("flag").alias("x")).join(b.select("key", "date", F.col("flag").alias("y")), ["key", "date"]).groupBy("key").agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreement"))


def episode_starts(flags: DataFrame) -> DataFrame:
    """(key, session): the first session of each stretch of the flag."""
    w = Window.partitionBy("key").orderBy("session")
    return flags.withColumn("start", edges(F.col("flag"), w)).where("start").select("key", "session")


def _matched(reach: int):
    """Arrow function: events (key, island, session, side), sorted, to (key, a, b): each of a takes the nearest of b that isn't taken (the earlier of equals), within reach. Holds events of the last 2 * reach sessions alone."""
    import pyarrow as pa

    def run(batches):
        group, waiting, free, out = None, [], [], []

        def settle(until):
            """Decides those of a that no event from until on can change."""
            while waiting and (until is None or waiting[0] + reach < until):
                x = waiting.pop(0)
                while free and free[0] < x - reach:
                    out.append((group[0], None, free.pop(0)))
                near = min((y for y in free if y <= x + reach), key=lambda y: (abs(y - x), y), default=None)
                if near is not None:
                    free.remove(near)
                out.append((group[0], x, near))
            least = waiting[0] if waiting else until
            while free and (least is None or free[0] < least - reach):
                out.append((group[0], None, free.pop(0)))

        def taken(kind):
            cols = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64()))], ["key", "a", "b"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, island, session, side in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (key, island) != group:
                    settle(None)
                    group = (key, island)
                settle(session)
                (free if side else waiting).append(session)
            yield taken(kind)
        if group is not None:
            settle(None)
            yield taken(kind)

    return run


def match_events(a: DataFrame, b: DataFrame, reach: int = 5) -> DataFrame:
    """a, b (key, session): rows (key, a, b), the greedy matches in the order of a's events, and each event without one beside a null.

    Events further apart than reach split a key's into chains that have no bearing on each
    other, so these are matched in parallel, each in one pass that holds few events. Repeated
    events count once; null keys and sessions have no part.
    """
    events = a.select("key", F.col("session").cast("long").alias("session"), F.lit(False).alias("side")).union(b.select("key", F.col("session").cast("long"), F.lit(True)))
    events = cut(events.where("key is not null and session is not null").distinct())
    chains = islands(events, ["key"], "session", reach).select("key", "island", "session", "side")
    chains = chains.repartition("key", "island").sortWithinPartitions("key", "island", "session", "side")
    return chains.mapInArrow(_matched(reach), f"key {events.schema['key'].dataType.simpleString()}, a long, b long")


def one_sided(a: DataFrame, b: DataFrame, ends: DataFrame, reach: int = 5) -> DataFrame:
    """(key, side, session, pending): events without a counterpart; within reach of the series' end (ends: key, last) they are pending.

    What of b is left is matched anew against all of a, so an event of a may excuse two of b.
    """
    m = cut(match_events(a, b, reach))
    left = m.where("a is null").select("key", F.col("b").alias("session"))
    again = match_events(left, a, reach).where("a is not null and b is null").select("key", F.lit("vendor").alias("side"), F.col("a").alias("session"))
    rows = m.where("b is null").select("key", F.lit("self").alias("side"), F.col("a").alias("session")).union(again)
    return rows.join(ends, "key").select("key", "side", "session", (F.col("last") - F.col("session") <= reach).alias("pending"))


def tail_mismatches(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Dates among the last n common ones on which the flags differ: (key, date)."""
    j = a.select("key", "date", F.col("flag").alias("x")).join(b.select("key", "date", F.col("flag").alias("y")), ["key", "date"])
    w = Window.partitionBy("key").orderBy(F.desc("date"))
    return j.withColumn("k", F.row_number().over(w)).where((F.col("k") <= n) & (F.col("x") != F.col("y"))).select("key", "date")


EDGE_FIELDS = ("d1_on", "d2_on", "d3_on", "d4_on", "n_dimensions")


def edge_compare(deployed: DataFrame, candidate: DataFrame, days: int = 10) -> DataFrame:
    """(universe, date, field, deployed, candidate): cells that differ on the last days common sessions; nothing where there are fewer in common (see edge_summary)."""
    pick = lambda df, s: df.select("universe", "date", *[F.col(f).cast("int").alias(f"{f}_{s}") for f in EDGE_FIELDS])
    j = pick(deployed, "d").join(pick(candidate, "c"), ["universe", "date"])
    w = Window.partitionBy("universe")
    j = j.select("*", F.row_number().over(w.orderBy(F.desc("date"))).alias("k"), F.count("*").over(w).alias("n")).where((F.col("k") <= days) & (F.col("n") >= days))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_d").alias("deployed"), F.col(f"{f}_c").alias("candidate")) for f in EDGE_FIELDS])
    return j.select("universe", "date", F.inline(cells)).where("deployed <> candidate")


def edge_summary(deployed: DataFrame, candidate: DataFrame, days: int = 10) -> DataFrame:
    """(universe, days_compared, insufficient_overlap, mismatches, mismatch_days)."""
    common = deployed.select("universe", "date").join(candidate.select("universe", "date"), ["universe", "date"]).groupBy("universe").agg(F.count("*").alias("n"))
    found = edge_compare(deployed, candidate, days).groupBy("universe").agg(F.count("*").alias("m"), F.count_distinct("date").alias("d"))
    return common.join(found, "universe", "left").select("universe", F.least("n", F.lit(days)).alias("days_compared"), (F.col("n") < days).alias("insufficient_overlap"), F.coalesce("m", F.lit(0)).alias("mismatches"), F.coalesce("d", F.lit(0)).alias("mismatch_days"))


def joint(*series: DataFrame) -> DataFrame:
    """Series (date, value) side by side, on dates on which all have a value."""
    out = series[0]
    for s in series[1:]:
        out = out.join(s, "date")
    return out.na.drop()


def count_lines(counts: DataFrame, p: ThrustParams) -> DataFrame:
    """The lines that raw counts (universe, session, date, advances, declines) give, from any source: zweig_line, deemer_ratio and the flag deemer."""
    adv, dec = F.col("advances"), F.col("declines")
    w = by("universe")
    df = ema(counts.withColumn("ad_ratio", adv / F.nullif(adv + dec, F.lit(0))), ["universe"], {"zweig_line": ("ad_ratio", p.zweig_span)})
    ratio = rolling_sum(adv, w, p.deemer_window) / F.nullif(rolling_sum(dec, w, p.deemer_window), F.lit(0))
    return df.withColumn("deemer_ratio", ratio).withColumn("deemer", F.coalesce(F.col("deemer_ratio") > p.deemer_ratio, F.lit(False)))


def all_apart(a: DataFrame, b: DataFrame, tolerance: float, n: int) -> DataFrame:
    """a, b (key, date, value): every date on which both have a value, and the values lie more than tolerance apart: (key, date, diff, recent). recent: the date is among the last n on which both have one."""
    j = a.select("key", "date", F.col("value").alias("x")).join(b.select("key", "date", F.col("value").alias("y")), ["key", "date"]).na.drop()
    w = Window.partitionBy("key").orderBy(F.desc("date"))
    diff = F.abs(F.col("x") - F.col("y"))
    return j.withColumn("recent", F.row_number().over(w) <= n).where(diff > tolerance).select("key", "date", diff.alias("diff"), "recent")


def apart(a: DataFrame, b: DataFrame, tolerance: float, n: int) -> DataFrame:
    """The recent ones of all_apart: (key, date, diff)."""
    return all_apart(a, b, tolerance, n).where("recent").drop("recent")
