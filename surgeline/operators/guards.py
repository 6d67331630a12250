"""Rules over data and documents; each gives its failures as an array of strings, empty for a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failures(*rules: tuple[Column, Column]) -> Column:
    """(condition of failure, message) rules in order; a null condition doesn't fail."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in rules]), lambda x: x.isNotNull())


def plain_symbol(c: Column) -> Column:
    """Trimmed, with - for a dot."""
    return F.replace(F.trim(c), F.lit("."), F.lit("-"))


def base_ticker(c: Column) -> Column:
    """Without a trailing dash and digits, which tell uses of a ticker apart."""
    return F.regexp_replace(c, r"^(.+)-[0-9]+$", "$1")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r'[<>:"/\\|?*]', "_")


def current_members(df: DataFrame, symbol: str, order: str) -> DataFrame:
    """(symbol, pos): plain symbols that aren't blank, each at its first place."""
    return df.select(plain_symbol(F.col(symbol)).alias("symbol"), F.col(order).alias("pos")).where("symbol <> ''").groupBy("symbol").agg(F.min("pos").alias("pos"))


def collisions(symbols: DataFrame) -> DataFrame:
    """(base, uses): base tickers that several symbols share. A symbol that is there twice is an error."""
    n = symbols.groupBy("symbol").agg(F.count("*").alias("n"))
    ok = n.select("symbol", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate symbol "), F.col("symbol")))).otherwise(F.lit(1)).cast("int").alias("one"))
    return ok.groupBy(base_ticker(F.col("symbol")).alias("base")).agg(F.sum("one").alias("uses")).where("uses > 1")


def basis_gaps(series: DataFrame, a: str, b: str) -> DataFrame:
    """(symbol, only_a, only_b): symbols whose two bases have different dates."""
    days = series.where(F.col("basis").isin(a, b)).groupBy("symbol", "date").agg(F.max((F.col("basis") == a).cast("int")).alias("a"), F.max((F.col("basis") == b).cast("int")).alias("b"))
    return days.groupBy("symbol").agg(F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b")).where("only_a + only_b > 0")


def staleness(stamps: DataFrame, live: Column, most: int = 10) -> DataFrame:
    """stamps (symbol, stamp): number of distinct stamps, days of the oldest behind the live one, and whether that warns."""
    return stamps.agg(F.count_distinct("stamp").alias("stamps"), F.max(F.datediff(live, "stamp")).alias("drift_days")).withColumn("warn", F.col("drift_days") > most)


def completeness(expected: DataFrame, present: DataFrame, most: float = 0.05) -> DataFrame:
    """expected, present (universe, symbol): missing names and their share; ok up to most."""
    got = present.select("universe", "symbol").distinct().withColumn("here", F.lit(1))
    out = expected.distinct().join(got, ["universe", "symbol"], "left").groupBy("universe").agg(F.count("*").alias("expected"), F.count_if(F.col("here").isNull()).alias("missing"))
    return out.withColumn("ok", F.col("missing") <= most * F.col("expected"))


def members_per_day(members: DataFrame, active_only: bool = True) -> DataFrame:
    """members (universe, session, n): least, median and most members of days."""
    return members.where("n > 0" if active_only else "true").groupBy("universe").agg(F.min("n").alias("min_members"), F.median("n").alias("median_members"), F.max("n").alias("max_members"), F.count("*").alias("days"))


def roster_reason(source: DataFrame, current: DataFrame) -> DataFrame:
    """source, current (roster, snapshot_date, n_tickers): the first reason against a replacement, or ok. A null snapshot_date row stands for a roster without snapshots."""
    s = source.groupBy("roster").agg(F.count("snapshot_date").alias("n"), F.max("snapshot_date").alias("last"), F.count_if(F.coalesce("n_tickers", F.lit(0)) == 0).alias("empty"))
    c = current.groupBy("roster").agg(F.count("snapshot_date").alias("cn"), F.max("snapshot_date").alias("clast"))
    reason = F.when(F.col("n") == 0, "the source is empty").when(F.col("n") < F.col("cn"), "the source is shorter").when(F.col("last") < F.col("clast"), "the source is older").when(F.col("empty") > 0, "the source has an empty snapshot").otherwise("ok")
    return s.join(c, "roster").select("roster", reason.alias("reason"))


def depth_failures(probes: DataFrame) -> DataFrame:
    """probes (probe, ready, age_days, first_date, delisted): reasons why the store is too thin, stale or short; a store that isn't ready has only that."""
    later = failures(
        (F.col("age_days").isNull() | (F.col("age_days") > 7), F.lit("store is old")),
        (F.col("first_date").isNull() | (F.col("first_date") > F.lit("1991-01-01").cast("date")), F.lit("history lost reach")),
        (F.coalesce("delisted", F.lit(0)) < 15000, F.lit("delisted archive is thin")),
    )
    return probes.select("probe", F.when(F.coalesce("ready", F.lit(False)), later).otherwise(F.array(F.lit("not ready"))).alias("failures"))


def payload_failures(payloads: DataFrame, max_lag: int = 3, max_age: int = 45, window_start: str = "1990-12-28") -> DataFrame:
    """payloads (payload, as_of, lag, window_start, window_end, survivorship_bias, valid_count, floor, provider, layer, roster_age): reasons against publishing."""
    vendor = F.col("provider") == "vendor"
    rules = failures(
        (F.col("lag") > max_lag, F.lit("as_of lags")),
        (~F.col("window_end").eqNullSafe(F.col("as_of")), F.lit("window did not extend")),
        (~F.col("survivorship_bias").eqNullSafe(F.lit(False)), F.lit("membership was not applied")),
        (F.col("floor").isNotNull() & (F.col("valid_count").isNull() | (F.col("valid_count") < F.col("floor"))), F.lit("valid_count below floor")),
        (vendor & ~F.col("layer").eqNullSafe(F.lit("pit")), F.lit("wrong layer")),
        (vendor & ~F.col("window_start").eqNullSafe(F.lit(window_start).cast("date")), F.lit("history shortened")),
        (~vendor & (F.col("roster_age") > max_age), F.lit("roster is old")),
    )
    return payloads.select("payload", F.when(F.col("as_of").isNull(), F.array(F.lit("no as_of"))).otherwise(rules).alias("failures"))


def session_lag(as_of: DataFrame, sessions: DataFrame) -> DataFrame:
    """as_of (name, date, now): completed sessions (any universe's) after the date, up to now. The days between are laid out, so the join is an equal one."""
    after = F.when(F.col("now") > F.col("date"), F.sequence(F.date_add("date", 1), F.col("now"))).otherwise(F.array().cast("array<date>"))
    days = as_of.select("name", F.explode(after).alias("date")).join(sessions.select("date").distinct(), "date")
    return as_of.select("name").join(days.groupBy("name").agg(F.count("*").alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("lag"))


def age_days(stamp: Column, now: Column, zone: str = "Asia/Singapore") -> Column:
    """Whole days from a stamp to now, a stamp without a zone being in zone; never under 0. now is a timestamp in UTC."""
    has_zone = stamp.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    at = F.when(has_zone, F.to_timestamp(stamp)).otherwise(F.to_utc_timestamp(F.to_timestamp(stamp), zone))
    return F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400), F.lit(0)).cast("int")


def readiness(stores: DataFrame, required: list[str]) -> DataFrame:
    """stores (store, running, databases, delisted): the first reason why a store isn't ready, or ok."""
    reason = F.when(~F.coalesce("running", F.lit(False)), "service is down")
    for name in required:
        reason = reason.when(~F.coalesce(F.array_contains("databases", name), F.lit(False)), f"missing database: {name}")
    return stores.select("store", reason.when(F.coalesce("delisted", F.lit(0)) == 0, "no delisted members").otherwise("ok").alias("reason"))


def sync(source: DataFrame, current: DataFrame) -> DataFrame:
    """source, current (roster, snapshot_date, n_tickers): what becomes of each roster, and its last snapshot in force: a source that fails roster_reason is rejected, a newer or longer one is taken, another leaves the current one."""
    ends = lambda df, s: df.groupBy("roster").agg(F.count("snapshot_date").alias(f"{s}_n"), F.max("snapshot_date").alias(f"{s}_last"))
    j = ends(current, "c").join(ends(source, "s"), "roster", "left").join(roster_reason(source, current), "roster", "left")
    newer = (F.col("s_last") > F.col("c_last")) | (F.col("s_n") > F.col("c_n"))
    outcome = F.when(~F.col("reason").eqNullSafe(F.lit("ok")), "rejected").when(newer, "synced").otherwise("current")
    return j.select("roster", outcome.alias("outcome"), F.when(outcome == "synced", F.col("s_last")).otherwise(F.col("c_last")).alias("in_force"), "reason")


def refuse_incomplete(panel: DataFrame, expected: DataFrame, most: float = 0.05) -> DataFrame:
    """panel (universe, symbol, ...) as it is; an error where a universe lacks more than most of its expected names."""
    rate = completeness(expected, panel, most)
    checked = rate.select("universe", F.when(~F.col("ok"), F.raise_error(F.concat(F.lit("incomplete panel: "), F.col("universe")))).otherwise(F.lit(1)).cast("int").alias("checked_"))
    return panel.join(checked, "universe", "left").where("checked_ is null or checked_ = 1").drop("checked_")


def refuse_gaps(series: DataFrame, a: str, b: str) -> DataFrame:
    """series as it is; an error where a symbol's two bases have different dates."""
    gaps = basis_gaps(series, a, b).select("symbol", F.raise_error(F.concat(F.lit("dates of the bases differ: "), F.col("symbol"))).cast("int").alias("gap_"))
    return series.join(gaps, "symbol", "left").where("gap_ is null").drop("gap_")
