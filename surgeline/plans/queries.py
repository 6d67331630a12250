"""One query for each operator family over the driver's tables, with DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surgeline.functions import series as S
from surgeline.functions.chains import place
from surgeline.functions.joins import measured
from surgeline.operators import breadth as B
from surgeline.operators import compare as C
from surgeline.operators import guards as G
from surgeline.operators import portfolio as PF
from surgeline.operators import stress as ST
from surgeline.operators import study as E
from surgeline.params import HORIZONS, RELAXED, THRESHOLDS, TiltParams
from surgeline.plans.oracle import any_in, r, sql
from surgeline.sources import panel as D
from surgeline.sources.pull import BATCH, pull_batches
from surgeline.sources.versions import merge_parts, read_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Draws of the registered bootstraps, as many as the reference takes.
DRAWS = 2000
#: Rotations of the tilt's null, as many as the reference takes.
ROTATIONS = 2000


_kept: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """df, a few rows for each session, kept in memory until the next query is asked for."""
    _kept.append(df.persist())
    return _kept[-1]


def released(f):
    """f, after which nothing of earlier queries is kept. What they returned can still be read; it is made anew."""

    @wraps(f)
    def run(spark, d):
        while _kept:
            _kept.pop().unpersist()
        return f(spark, d)

    return run


def query(oracle: str, **params):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql(oracle, **params)
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to 6 places."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint", "smallint") else F.col(c) for c, t in df.select(*names).dtypes])


def _panel(spark, d, **kw):
    cells = D.cells(spark, d, **kw)
    sessions = D.calendar(cells)
    return D.dense(cells, sessions), sessions


def _daily(spark, d):
    return B.breadth(*_panel(spark, d), RELAXED)


def _lines(spark, d):
    return B.lines(_daily(spark, d), RELAXED)


def _flags(spark, d):
    return B.detectors(_lines(spark, d), RELAXED)


def _comp(spark, d):
    return B.composite(_flags(spark, d), RELAXED)


def _bench(spark, d):
    return D.benchmark(_panel(spark, d)[0])


def _study(spark, d, horizons=HORIZONS):
    """Composite, benchmark, lagged signal and forward returns in the valid window."""
    # a row for each session: small, and read by every horizon
    comp = kept(E.in_window(kept(_comp(spark, d))))
    bench = kept(_bench(spark, d).join(comp.select("universe", "session"), ["universe", "session"], "left_semi"))
    return comp, bench, E.lagged(comp, bench), E.forward(bench, horizons)


def _sides(spark, d, shift: int):
    """Hourly flags of each event type, and the same later by shift hours for every third hour."""
    hours = D.table(spark, d, "events").select(F.col("event_type").alias("key"), F.expr("cast((unix_seconds(date_trunc('hour', ts)) - unix_seconds(timestamp'2020-01-01 00:00:00')) div 3600 as int)").alias("session")).groupBy("key", "session").agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy("session")
    flags = hours.select("key", "session", (F.col("n") > F.avg("n").over(w.rowsBetween(-24, 0))).alias("flag"))
    a = C.episode_starts(flags)
    return flags, a, a.select("key", F.when(F.col("session") % 3 == 0, F.col("session") + shift).otherwise(F.col("session") - 1).alias("session")).distinct()


# sources


@query("SELECT ticker, date, px, volume FROM cells")
def panel_cells(spark, d):
    return D.cells(spark, d).select("ticker", "date", "px", "volume")


@query("SELECT CAST(session AS BIGINT) AS session, date FROM cal")
def calendar_sessions(spark, d):
    return rounded(D.calendar(D.cells(spark, d)), "session", "date")


@query("SELECT CAST(session AS BIGINT) AS session, ticker, px, CAST(volume AS BIGINT) AS volume FROM panel")
def panel_filled(spark, d):
    return rounded(_panel(spark, d)[0], "session", "ticker", "px", "volume")


@query("SELECT ticker, date, px FROM (SELECT ticker, date, px, row_number() OVER (PARTITION BY ticker, date ORDER BY fresh DESC) AS k FROM (SELECT ticker, date, px, 0 AS fresh FROM cells WHERE date < DATE '2000-06-01' UNION ALL SELECT ticker, date, px + 1, 1 FROM cells WHERE date >= DATE '2000-01-01')) WHERE k = 1")
def upsert_merge(spark, d):
    """A store by month, and a later delivery that is merged into the months that it touches."""
    c = D.cells(spark, d).select("ticker", "date", "px", F.date_format("date", "yyyy-MM").alias("month"))
    path = place(spark, "by-month")
    merge_parts(c.where("date < date'2000-06-01'"), path, "month", ["month", "ticker", "date"])
    merge_parts(c.where("date >= date'2000-01-01'").withColumn("px", F.col("px") + 1), path, "month", ["month", "ticker", "date"])
    return read_parts(spark, path).select("ticker", "date", "px")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS symbol, basis, CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date, CASE WHEN l_suppkey % 17 <> 0 THEN CAST(sum(l_quantity) AS DOUBLE) * CASE WHEN basis = 'NONE' THEN 1 ELSE 2 END END AS close, CASE WHEN l_suppkey % 17 <> 0 THEN count(*) ELSE 0 END AS volume, CASE WHEN l_suppkey % 17 = 0 THEN 'no answer for ' || l_suppkey ELSE '' END AS failure FROM lineitem CROSS JOIN (VALUES ('NONE'), ('TOTALRETURN')) AS v(basis) GROUP BY l_suppkey, basis, 3")
def series_pull(spark, d):
    """Series of every supplier's shipments, fetched by tasks as from a vendor; some symbols fail. The vendor's archive has a folder for each BATCH symbols or so, so a task reads what it asks for."""
    lines = D.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    symbols = lines.select("symbol").distinct()
    n = max(1, -(-symbols.count() // BATCH))
    part = (F.crc32(F.coalesce("symbol", F.lit("")).cast("binary")) % n).alias("part")
    known = F.col("symbol").isNotNull()
    sums = lines.groupBy(part, "symbol", "date").agg(F.when(known, F.sum("l_quantity").cast("double")).alias("close"), F.when(known, F.count("*")).alias("volume"))
    path = place(spark, "vendor")
    sums.repartition("part").write.partitionBy("part").parquet(path)

    def source(wanted, basis):
        import zlib

        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(path)
        series = {s: [] for s in wanted}
        for p in {zlib.crc32((s or "").encode()) % n for s in wanted}:
            rows = ds.dataset(f"{root}/part={p}", filesystem=fs, format="parquet").to_table(["symbol", "date", "close", "volume"])
            for s, day, close, volume in zip(*(c.to_pylist() for c in rows.columns)):
                if s in series:
                    series[s].append((day, close if basis == "NONE" or close is None else 2 * close, volume))
        for s, rows in series.items():
            yield s, OSError(f"no answer for {s}") if s is not None and int(s) % 17 == 0 else rows

    # a list of structs keeps a null symbol
    asked = symbols.groupBy(part).agg(F.sort_array(F.collect_list(F.struct("symbol"))).alias("s")).select(F.explode(F.array(F.lit("NONE"), F.lit("TOTALRETURN"))).alias("basis"), F.col("s.symbol").alias("symbols"))
    return pull_batches(asked.repartition(2 * n), source).select("symbol", "basis", "date", "close", F.coalesce("volume", F.lit(0)).cast("long").alias("volume"), F.coalesce("failure", F.lit("")).alias("failure"))


@query("SELECT ticker, max(date) AS last FROM cells GROUP BY ticker HAVING max(date) < DATE '2001-11-04'")
def stale_series(spark, d):
    return D.stale(D.cells(spark, d), F.lit("2001-11-04").cast("date")).select("ticker", "last")


def _members(spark, d):
    cells = D.cells(spark, d)
    months = cells.groupBy("universe", F.trunc("date", "MM").cast("date").alias("month"), "ticker").agg(F.sum("volume").alias("v"))
    top = months.withColumn("k", F.row_number().over(Window.partitionBy("universe", "month").orderBy(F.desc("v"), "ticker"))).where("k <= 15")
    return D.as_of(D.calendar(cells), top.select("universe", F.add_months("month", 1).alias("snapshot_date"), "ticker"))


@query("SELECT CAST(session AS BIGINT) AS session, date, ticker FROM memb")
def membership_asof(spark, d):
    return rounded(_members(spark, d), "session", "date", "ticker")


_counts = "CAST(session AS BIGINT) AS session, date, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in B.COUNTS)


@query(f"SELECT {_counts} FROM mdaily")
def membership_masked_breadth(spark, d):
    panel, sessions = _panel(spark, d)
    return rounded(B.breadth(D.masked(panel, _members(spark, d)), sessions, RELAXED), "session", "date", *B.COUNTS)


@query("SELECT CAST(session AS BIGINT) AS session, count(*) AS n, CAST(min(ticker) AS BIGINT) AS least FROM memb GROUP BY session")
def members_by_day(spark, d):
    return rounded(_members(spark, d).groupBy("session").agg(F.count("*").alias("n"), F.min("ticker").alias("least")), "session", "n", "least")


# breadth and lines


@query(f"SELECT {_counts} FROM daily")
def breadth_counts(spark, d):
    return rounded(_daily(spark, d), "session", "date", *B.COUNTS)


@query(f"SELECT CAST(session AS BIGINT) AS session, {r('pct_above')} FROM base")
def pct_above_ma50(spark, d):
    return rounded(_daily(spark, d), "session", "pct_above")


@query("SELECT CAST(session AS BIGINT) AS session, new_highs, new_lows, hl_valid_count FROM daily")
def new_high_low_252(spark, d):
    return rounded(_daily(spark, d), "session", "new_highs", "new_lows", "hl_valid_count")


@query(f"SELECT CAST(session AS BIGINT) AS session, {r('up_volume_ratio')} FROM base")
def up_volume_ratio(spark, d):
    return rounded(_daily(spark, d), "session", "up_volume_ratio")


for _name, _col in (("deemer_ratio_10", "deemer_ratio"), ("zweig_ema10", "zweig_line"), ("mcclellan_osc", "mcc")):
    QUERIES[_name] = lambda spark, d, c=_col: rounded(_lines(spark, d), "session", c)
    ORACLE_SQL[_name] = sql(f"SELECT CAST(session AS BIGINT) AS session, {r(_col)} FROM ln")


@query("SELECT CAST(session AS BIGINT) AS session, round(zweig_line - CASE WHEN session > 10 THEN avg(ad_ratio) OVER (ORDER BY session ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END, 6) AS ema_less_sma FROM ln")
def sma10_vs_ema10(spark, d):
    w = S.by("universe")
    df = _lines(spark, d)
    return rounded(df.select("session", (F.col("zweig_line") - S.full(F.avg("ad_ratio").over(S.trailing(w, 10)), F.col("ad_ratio"), w, 10)).alias("ema_less_sma")), "session", "ema_less_sma")


for _name, _cols in (("d1_flags", ["zweig", "deemer", "mcclellan", "d1"]), ("d2_flags", ["d2"]), ("d3_flags", ["nhnl_ratio", "nhnl_net", "d3"]), ("d4_flags", ["d4"])):
    QUERIES[_name] = lambda spark, d, c=_cols: rounded(_flags(spark, d), "session", *c)
    ORACLE_SQL[_name] = sql(f"SELECT CAST(session AS BIGINT) AS session, {', '.join(_cols)} FROM det")


@query(f"SELECT CAST(session AS BIGINT) AS session, d1_on, d2_on, d3_on, d4_on, CAST(n_dimensions AS BIGINT) AS n_dimensions, {r('score')} FROM comp")
def composite_score(spark, d):
    return rounded(_comp(spark, d), "session", "d1_on", "d2_on", "d3_on", "d4_on", "n_dimensions", "score")


@query("SELECT CAST(session AS BIGINT) AS session, date, CAST(n_dimensions AS BIGINT) AS n_dimensions FROM comp WHERE event AND data_ok")
def composite_events(spark, d):
    return rounded(_comp(spark, d).where("event and data_ok"), "session", "date", "n_dimensions")


@query("SELECT CAST(session AS BIGINT) AS session, burn_in, data_ok FROM comp")
def burn_in_gate(spark, d):
    return rounded(_comp(spark, d), "session", "burn_in", "data_ok")


_readings = ["zweig_line", "deemer_ratio", "mcc", "pct_above", "high_ratio", "up_volume_ratio"]


@query(f"SELECT CAST(session AS BIGINT) AS session, date, {r(*_readings)}, CAST(net_highs AS BIGINT) AS net_highs, round(best_up, 6) AS best_up FROM (SELECT *, max(up_volume_ratio) OVER (ORDER BY session ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS best_up FROM ln) WHERE session = (SELECT max(session) FROM ln)")
def latest_readings(spark, d):
    df = _lines(spark, d).withColumn("best_up", F.max("up_volume_ratio").over(S.trailing(S.by("universe"), 5)))
    return rounded(B.latest(df, [*_readings, "net_highs", "best_up"]), "session", "date", *_readings, "net_highs", "best_up")


@query("SELECT median(valid_count) / 500e0 AS scale FROM daily WHERE valid_count > 0")
def universe_scale(spark, d):
    return B.scale_of(_daily(spark, d)).select("scale")


@query(
    """SELECT u.universe, CAST(u.session AS BIGINT) AS session, count(*) FILTER (u.px > u.prev) AS advances, count(*) FILTER (u.px < u.prev) AS declines, count(u.prev) AS valid_count FROM (
    SELECT universe, session, px, lag(px) OVER (PARTITION BY universe, ticker ORDER BY session) AS prev FROM (
      SELECT c.universe, c.session, t.ticker, last_value(x.px IGNORE NULLS) OVER (PARTITION BY c.universe, t.ticker ORDER BY c.session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px
      FROM (SELECT universe, date, row_number() OVER (PARTITION BY universe ORDER BY date) AS session FROM (SELECT DISTINCT CAST(ticker % 5 AS VARCHAR) AS universe, date FROM cells)) c
      JOIN (SELECT DISTINCT ticker, CAST(ticker % 5 AS VARCHAR) AS universe FROM cells) t ON t.universe = c.universe LEFT JOIN cells x ON x.date = c.date AND x.ticker = t.ticker) WHERE px IS NOT NULL) u GROUP BY 1, 2"""
)
def universes_in_one_job(spark, d):
    panel, sessions = _panel(spark, d, universe="s_nationkey % 5")
    return rounded(B.breadth(panel, sessions, RELAXED), "universe", "session", "advances", "declines", "valid_count")


# studies


@query(f"SELECT CAST(session AS BIGINT) AS session, horizon, {r('fwd')} FROM fw")
def forward_returns_grid(spark, d):
    return rounded(_study(spark, d)[3], "session", "horizon", "fwd")


@query(f"SELECT CAST(session AS BIGINT) AS session, horizon, {r('mdd')} FROM fwd")
def forward_max_drawdown(spark, d):
    _, bench, _, fwd = _study(spark, d)
    return rounded(fwd.join(E.drawdowns(fwd, bench), ["universe", "session", "horizon"], "left"), "session", "horizon", "mdd")


_cond = ["win_rate", "median_ret", "mean_ret", "p10", "p25", "p75", "p90", "median_max_dd"]


@query(f"SELECT CAST(threshold AS BIGINT) AS threshold, horizon, n, {r(*_cond)} FROM cond")
def conditional_table(spark, d):
    _, bench, signal, fwd = _study(spark, d)
    return rounded(E.conditional(signal, fwd, bench), "threshold", "horizon", "n", *_cond)


@query("SELECT s.score AS score, count(*) AS n, round(quantile_cont(f.mdd, 0.5), 6) AS median_max_dd FROM sig s JOIN fwd f ON f.session = s.session WHERE f.horizon = '1m' AND f.mdd IS NOT NULL AND s.score >= 1 GROUP BY 1")
def drawdown_by_score(spark, d):
    _, bench, signal, fwd = _study(spark, d, {"1m": 21})
    rows = signal.join(E.drawdowns(fwd, bench, {"1m": 21}), ["universe", "session"]).where("score >= 1")
    return rounded(rows.groupBy("score").agg(F.count("*").alias("n"), F.percentile("mdd", F.lit(0.5)).alias("median_max_dd")), "score", "n", "median_max_dd").withColumn("score", F.col("score").cast("int"))


_base = ["base_win_rate", "base_win_lo", "base_win_hi", "base_median_ret", "base_ret_lo", "base_ret_hi"]


@query(f"SELECT horizon, {r(*_base)}, n_total FROM bline", draws=DRAWS)
def block_bootstrap_baseline(spark, d):
    return rounded(E.baseline(_study(spark, d)[3], DRAWS), "horizon", *_base, "n_total")


@query(f"SELECT CAST(threshold AS BIGINT) AS threshold, horizon, n, {r('win_lift', 'ret_lift')}, win_beyond_noise, ret_beyond_noise FROM lifted", draws=DRAWS)
def lift_table(spark, d):
    _, bench, signal, fwd = _study(spark, d)
    return rounded(E.lift(E.conditional(signal, fwd, bench), E.baseline(fwd, DRAWS)), "threshold", "horizon", "n", "win_lift", "ret_lift", "win_beyond_noise", "ret_beyond_noise")


def _cluster_rows(bench, signal):
    rows = signal.where("event").join(bench.select("universe", "session", "date"), ["universe", "session"])
    return E.clusters(rows.select("universe", "date", F.explode(F.filter(F.array(*[F.lit(t) for t in THRESHOLDS]), lambda t: F.col("score") >= t)).alias("threshold")), ["universe", "threshold"])


@query("SELECT CAST(threshold AS BIGINT) AS threshold, CAST(sum(fresh) AS BIGINT) AS clusters FROM (SELECT t.threshold, CASE WHEN date_diff('day', lag(b.date) OVER (PARTITION BY t.threshold ORDER BY b.date), b.date) <= 63 THEN 0 ELSE 1 END AS fresh FROM sig s JOIN bw b ON b.session = s.session JOIN th t ON s.score >= t.threshold WHERE s.event) GROUP BY 1")
def cluster_count(spark, d):
    _, bench, signal, _ = _study(spark, d, {"1w": 5})
    return rounded(_cluster_rows(bench, signal), "threshold", "clusters")


@query("SELECT CASE WHEN win_beyond_noise AND ret_beyond_noise THEN 'PASS' ELSE 'FAIL' END AS verdict, (win_beyond_noise OR ret_beyond_noise) AND (SELECT coalesce(CAST(sum(fresh) AS BIGINT), 0) FROM (SELECT CASE WHEN date_diff('day', lag(b.date) OVER (ORDER BY b.date), b.date) <= 63 THEN 0 ELSE 1 END AS fresh FROM sig s JOIN bw b ON b.session = s.session WHERE s.event AND s.score >= 3)) < 10 AS caveat FROM lifted WHERE threshold = 3 AND horizon = '6m'", draws=DRAWS)
def decision_rule(spark, d):
    _, bench, signal, fwd = _study(spark, d)
    return E.decision(E.lift(E.conditional(signal, fwd, bench), E.baseline(fwd, DRAWS)), _cluster_rows(bench, signal)).select("verdict", "caveat")


@query("SELECT count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(a, b) END, 6) AS rho FROM (SELECT rank() OVER (ORDER BY threshold) + 0e0 AS a, rank() OVER (ORDER BY win_lift) + (count(*) OVER (PARTITION BY win_lift) - 1) / 2e0 AS b FROM lifted WHERE horizon = '6m' AND n > 0)", draws=DRAWS)
def spearman_monotonicity(spark, d):
    _, bench, signal, fwd = _study(spark, d)
    return rounded(E.monotonic(E.lift(E.conditional(signal, fwd, bench), E.baseline(fwd, DRAWS))), "n", "rho")


@query("SELECT e.date AS event_date, CAST(e.n_dimensions AS BIGINT) AS n_dimensions, CAST(e.session + 1 AS BIGINT) AS anchor, " + ", ".join(f"round((SELECT px FROM bench WHERE session = e.session + 1 + {h}) / b.px - 1, 6) AS ret_{k}" for k, h in HORIZONS.items()) + ", round((SELECT max_by(px, session) FROM bench) / b.px - 1, 6) AS ret_to_date FROM (SELECT * FROM comp WHERE event AND n_dimensions >= 1 ORDER BY session DESC LIMIT 1) e JOIN bench b ON b.session = e.session + 1")
def last_signal(spark, d):
    return rounded(E.last_signal(_comp(spark, d), _bench(spark, d)), "event_date", "n_dimensions", "anchor", *[f"ret_{k}" for k in HORIZONS], "ret_to_date")


@query("SELECT min(date) AS first, max(date) AS last, count(*) AS sessions, CAST(sum(CASE WHEN event THEN 1 ELSE 0 END) AS BIGINT) AS events FROM cw")
def valid_window(spark, d):
    return rounded(E.in_window(_comp(spark, d)).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("sessions"), F.count_if("event").alias("events")), "first", "last", "sessions", "events")


@query("SELECT c.date, CAST(c.n_dimensions AS BIGINT) AS n_dimensions, c.d1_on, c.d2_on, c.d3_on, c.d4_on, c.event, round(b.px, 2) AS px FROM cw c JOIN bench b ON b.session = c.session")
def timeline(spark, d):
    comp = E.in_window(_comp(spark, d)).join(_bench(spark, d).select("universe", "session", F.round("px", 2).alias("px")), ["universe", "session"], "left")
    return rounded(comp, "date", "n_dimensions", "d1_on", "d2_on", "d3_on", "d4_on", "event", "px")


@query("SELECT CAST(a.threshold AS BIGINT) AS threshold, a.horizon, CAST(b.n - a.n AS BIGINT) AS delta_n, round(b.win_rate - a.win_rate, 6) AS delta_win, round(b.median_ret - a.median_ret, 6) AS delta_median, (coalesce(abs(b.win_rate - a.win_rate) > 0.02, false) OR coalesce(abs(b.median_ret - a.median_ret) > 0.01, false) OR abs(b.n - a.n) > 2) AS erratum FROM cond a JOIN (SELECT t.threshold, z.horizon, count(f.fwd) AS n, avg(CASE WHEN f.fwd > 0 THEN 1e0 WHEN f.fwd IS NOT NULL THEN 0e0 END) AS win_rate, quantile_cont(f.fwd, 0.5) AS median_ret FROM th t CROSS JOIN hz z LEFT JOIN (SELECT s.score, f.horizon, f.fwd FROM sig s JOIN fw f ON f.session = s.session WHERE s.event AND f.fwd IS NOT NULL AND s.session > 1000) f ON f.horizon = z.horizon AND f.score >= t.threshold GROUP BY 1, 2) b ON b.threshold = a.threshold AND b.horizon = a.horizon")
def reconcile_windows(spark, d):
    _, bench, signal, fwd = _study(spark, d)
    return rounded(E.reconcile(E.conditional(signal, fwd, bench), E.conditional(signal.where("session > 1000"), fwd, bench)), "threshold", "horizon", "delta_n", "delta_win", "delta_median", "erratum")


# stress


def _level(spark, d, comp=None):
    comp = E.in_window(_comp(spark, d)) if comp is None else comp
    return comp.select("universe", "session", "date", F.col("pct_above").alias("level"))


@query(
    """SELECT horizon, predictor, count(*) AS n, round(covar_pop(x, fwd) / stddev_pop(x), 6) AS slope_std, round(pow(corr(x, fwd), 2), 6) AS r2, count(*) FILTER (i % h = 0) AS n_nonoverlap, round(covar_pop(x, fwd) FILTER (i % h = 0) / stddev_pop(x) FILTER (i % h = 0), 6) AS slope_nonoverlap FROM (
    SELECT *, row_number() OVER (PARTITION BY horizon, predictor ORDER BY session) - 1 AS i FROM (
      SELECT p.predictor, p.session, p.x, f.horizon, f.h, f.fwd FROM (
        SELECT session, 'level' AS predictor, lag(pct_above) OVER (ORDER BY session) AS x FROM cw UNION ALL
        SELECT session, 'change_21d', lag(c) OVER (ORDER BY session) FROM (SELECT session, pct_above - lag(pct_above, 21) OVER (ORDER BY session) AS c FROM cw)) p
      JOIN fw f ON f.session = p.session WHERE p.x IS NOT NULL AND f.fwd IS NOT NULL AND f.horizon <> '1w')) GROUP BY 1, 2"""
)
def level_change_regression(spark, d):
    comp, _, _, fwd = _study(spark, d)
    return rounded(ST.regressions(_level(spark, d, comp).select("universe", "session", "level"), fwd), "horizon", "predictor", "n", "slope_std", "r2", "n_nonoverlap", "slope_nonoverlap")


@query(
    """SELECT round(quantile_cont(slope, 0.5), 6) AS slope_med, round(quantile_cont(slope, 0.05), 6) AS slope_lo5, round(quantile_cont(slope, 0.95), 6) AS slope_hi95, quantile_cont(slope, 0.05) > 0 OR quantile_cont(slope, 0.95) < 0 AS excludes_zero FROM (
    SELECT s.draw, covar_pop(p.x, p.y) / stddev_pop(p.x) AS slope FROM (
      SELECT draw, (u * greatest(n - {block}, 1)) // 2147483647 AS start FROM (
        SELECT draw, n, (((z * 48271 + b * 16807 + 7) % 2147483647) * 48271) % 2147483647 AS u FROM (
          SELECT draw, b, n, (((CAST(12345 AS BIGINT) * 48271 + 42 * 16807 + 7) % 2147483647) * 48271 + draw * 16807 + 7) % 2147483647 AS z FROM (SELECT count(*) AS n FROM xy) CROSS JOIN (SELECT CAST(range AS BIGINT) AS draw FROM range({draws})) JOIN (SELECT CAST(range AS BIGINT) AS b FROM range(200)) ON b < n // {block}))) s
    JOIN xy p ON p.i >= s.start AND p.i < s.start + {block} GROUP BY 1)""".replace("xy", "(SELECT row_number() OVER (ORDER BY c.session) - 1 AS i, c.pct_above AS x, f.fwd AS y FROM cw c JOIN fw f ON f.session = c.session WHERE f.horizon = '1m' AND f.fwd IS NOT NULL AND c.pct_above IS NOT NULL)"),
    draws=DRAWS,
)
def bootstrap_slope(spark, d):
    comp, _, _, fwd = _study(spark, d, {"1m": 21})
    fwd = fwd.where("fwd is not null")
    rows = _level(spark, d, comp).where("level is not null").join(fwd, ["universe", "session"])
    rows = rows.select(F.col("universe").alias("key"), (F.row_number().over(S.by("universe")) - 1).cast("long").alias("i"), F.col("level").alias("x"), F.col("fwd").alias("y"))
    return rounded(ST.bootstrap_slopes(rows, DRAWS, 21), "slope_med", "slope_lo5", "slope_hi95", "excludes_zero")


_q = "(SELECT quantile_cont(pct_above, {q}) FROM cw)"
_cands = f"""SELECT kind, i FROM (SELECT 'washout_entry' AS kind, CAST(session AS BIGINT) AS i, pct_above < {_q.format(q=0.25)} AND {_q.format(q=0.25)} <= b AS on FROM (SELECT session, pct_above, lag(pct_above) OVER (ORDER BY session) AS b FROM cw)
    UNION ALL SELECT 'strength_entry', session, pct_above > {_q.format(q=0.75)} AND {_q.format(q=0.75)} >= b FROM (SELECT session, pct_above, lag(pct_above) OVER (ORDER BY session) AS b FROM cw)) WHERE on""".replace(" AS on", " AS hit").replace("WHERE on", "WHERE hit")


def _greedy(rest: str) -> str:
    """Thinned events: each next one is the first candidate more than 21 sessions later."""
    return f"WITH RECURSIVE cand AS MATERIALIZED ({sql(_cands)}), thin AS (SELECT kind, min(i) AS i FROM cand GROUP BY kind UNION ALL SELECT t.kind, (SELECT min(c.i) FROM cand c WHERE c.kind = t.kind AND c.i > t.i + 21) FROM thin t WHERE t.i IS NOT NULL) {rest}"


@query("SELECT 1")
def quartile_events(spark, d):
    return rounded(ST.quartile_events(_level(spark, d)), "kind", "session")


ORACLE_SQL["quartile_events"] = _greedy("SELECT kind, i AS session FROM thin WHERE i IS NOT NULL")


def _monthly(spark, d):
    rows = D.cells(spark, d).groupBy("date").agg(F.sum(F.when(F.col("ticker") < 12, F.col("px") * F.col("volume"))).alias("a"), F.sum(F.when(F.col("ticker") >= 12, F.col("px") * F.col("volume"))).alias("b")).where("a is not null and b is not null")
    return ST.month_ends(rows, ["a", "b"])


_narrow = """SELECT threshold, month, diff, fwd12, diff > threshold AS flagged FROM (
    SELECT month, (CAST(a AS DOUBLE) / lag(a, 12) OVER (ORDER BY month) - CAST(b AS DOUBLE) / lag(b, 12) OVER (ORDER BY month)) * 100 AS diff, CAST(lead(a, 12) OVER (ORDER BY month) AS DOUBLE) / a - 1 AS fwd12 FROM (
      SELECT CAST(date_trunc('month', date) AS DATE) AS month, max_by(a, date) AS a, max_by(b, date) AS b FROM (SELECT date, sum(px * volume) FILTER (ticker < 12) AS a, sum(px * volume) FILTER (ticker >= 12) AS b FROM cells GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1))
    CROSS JOIN (VALUES (0), (2), (5)) AS v(threshold) WHERE diff IS NOT NULL AND fwd12 IS NOT NULL"""


@query(f"SELECT CAST(threshold AS BIGINT) AS threshold, count(*) AS n_months, count(*) FILTER (flagged) AS n_flagged, round(avg(CASE WHEN fwd12 > 0 THEN 1e0 ELSE 0e0 END) FILTER (flagged), 6) AS share_pos FROM ({_narrow}) GROUP BY 1")
def month_end_narrowness(spark, d):
    n = ST.narrowness(_monthly(spark, d))
    return rounded(n.groupBy("threshold").agg(F.count("*").alias("n_months"), F.count_if("flagged").alias("n_flagged"), F.avg(F.when(F.col("flagged"), (F.col("fwd12") > 0).cast("double"))).alias("share_pos")), "threshold", "n_months", "n_flagged", "share_pos")


@query(f"SELECT CAST(threshold AS BIGINT) AS threshold, min(month) AS first, max(month) AS last, count(*) AS length, round(avg(fwd12), 6) AS mean_value, round(avg(CASE WHEN fwd12 > 0 THEN 1e0 ELSE 0e0 END), 6) AS share_pos FROM (SELECT *, k - row_number() OVER (PARTITION BY threshold ORDER BY month) AS island FROM (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY month) AS k FROM ({_narrow})) WHERE flagged) GROUP BY threshold, island")
def flag_episodes(spark, d):
    return rounded(ST.episodes(ST.narrowness(_monthly(spark, d)), ["threshold"], "month", "flagged", "fwd12"), "threshold", "first", "last", "length", "mean_value", "share_pos")


_anchor_days = [("1996-03-01", "month"), ("1997-07-15", "day"), ("1999-01-04", "day"), ("2000-10-01", "month"), ("2001-11-30", "day")]
_fires = " UNION ALL ".join(f"SELECT date, '{c}' AS detector FROM comp WHERE data_ok AND {c}" for c in ("zweig", "mcclellan", "deemer", "d1"))


@query("SELECT v.anchor, v.kind, count(f.date) AS hits, count(DISTINCT f.detector) AS detectors, count(f.date) > 0 AS match FROM (VALUES " + ", ".join(f"(DATE '{a}', '{k}')" for a, k in _anchor_days) + f") AS v(anchor, kind) LEFT JOIN ({_fires}) f ON CASE v.kind WHEN 'day' THEN f.date BETWEEN v.anchor - 5 AND v.anchor + 5 ELSE date_trunc('month', f.date) = date_trunc('month', v.anchor) END GROUP BY 1, 2")
def anchor_match(spark, d):
    anchors = spark.createDataFrame(_anchor_days, "anchor string, kind string").withColumn("anchor", F.to_date("anchor"))
    return rounded(ST.anchor_hits(ST.fires(_comp(spark, d), ["zweig", "mcclellan", "deemer", "d1"]), anchors), "anchor", "kind", "hits", "detectors", "match")


@query(f"SELECT detector, count(*) AS fires FROM ({_fires}) GROUP BY 1")
def fire_counts(spark, d):
    return rounded(ST.fires(_comp(spark, d), ["zweig", "mcclellan", "deemer", "d1"]).groupBy("detector").agg(F.count("*").alias("fires")), "detector", "fires")


# portfolios


def _bonds(spark, d):
    yields = _bench(spark, d).withColumn("yield_pct", 3.0 + 2.0 * F.sin(F.col("session") / 90.0))
    return PF.constant_maturity_return(yields, ["universe"])


def _tilts(spark, d, variants):
    """(universe, variant, delta, hold, session, date, px, bond_ret, tilt) for each variant, on the signal of the session before."""
    w = S.by("universe")
    signal = _comp(spark, d).select("universe", "session", F.lag("event").over(w).alias("event"), F.lag("n_dimensions").over(w).alias("score"))
    rows = PF.tilts(signal, variants, ["universe"]).select("universe", "variant", "delta", "hold", "session", "tilt")
    return rows.join(measured(_bonds(spark, d).select("universe", "session", "date", "px", "bond_ret")), ["universe", "session"])


_KEYS = ["universe", "variant", "delta", "hold"]
_GRID = [(v, x, h) for v in TiltParams().variants for x in TiltParams().deltas for h in TiltParams().holds]
_values = lambda vs: ", ".join(f"('{v}', {int(x * 10)}e-1, {h})" for v, x, h in vs)
_METRICS = ["cagr", "vol", "sharpe", "max_dd", "years", "turnover_per_year"]


@query("SELECT CAST(session AS BIGINT) AS session, round(bond_ret, 9) AS bond_ret FROM bonds")
def constant_maturity_return(spark, d):
    return _bonds(spark, d).select(F.col("session").cast("long").alias("session"), F.round("bond_ret", 9).alias("bond_ret"))


for _name, _v in (("tilt_v1", ("V1", 0.2, 21)), ("tilt_v2", ("V2", 0.2, 21))):
    QUERIES[_name] = lambda spark, d, v=_v: rounded(_tilts(spark, d, [v]), "session", "tilt")
    ORACLE_SQL[_name] = sql(f"SELECT CAST(session AS BIGINT) AS session, {r('tilt')} FROM tilts", variants=_values([_v]))


@query("SELECT CAST(session AS BIGINT) AS session, round(equity, 6) AS equity, round(moved, 6) AS moved FROM sim", variants=_values([("V1", 0.2, 21)]))
def backtest_equity(spark, d):
    return rounded(PF.backtest(_tilts(spark, d, [("V1", 0.2, 21)]), _KEYS), "session", "equity", "moved")


@query(f"SELECT {r(*_METRICS)} FROM met", variants=_values([("V1", 0.2, 21)]))
def portfolio_metrics(spark, d):
    return rounded(PF.metrics(PF.backtest(_tilts(spark, d, [("V1", 0.2, 21)]), _KEYS), _KEYS), *_METRICS)


@query(f"SELECT variant, CAST(delta AS DOUBLE) AS delta, CAST(hold AS BIGINT) AS hold, {r(*_METRICS)} FROM met", variants=_values(_GRID))
def variant_grid(spark, d):
    return rounded(PF.metrics(PF.backtest(_tilts(spark, d, _GRID), _KEYS), _KEYS), "variant", "delta", "hold", *_METRICS)


@query("SELECT variant, count(*) FILTER (tilt > 0) AS days_tilted, round(avg(CASE WHEN tilt > 0 THEN 1e0 ELSE 0e0 END), 6) AS share_tilted, count(*) FILTER (tilt > 0 AND NOT coalesce(before > 0, false)) AS n_tilts FROM (SELECT *, lag(tilt) OVER (PARTITION BY variant ORDER BY session) AS before FROM tilts) GROUP BY 1", variants=_values([("V1", 0.2, 21), ("V2", 0.2, 21)]))
def tilt_diagnostics(spark, d):
    return rounded(PF.tilt_stats(_tilts(spark, d, [("V1", 0.2, 21), ("V2", 0.2, 21)]), _KEYS), "variant", "days_tilted", "share_tilted", "n_tilts")


@query(f"SELECT variant AS era, {r(*_METRICS)} FROM emet", variants=_values([("V1", 0.2, 21)]))
def era_split(spark, d):
    """Each era's backtest starts anew."""
    rows = _tilts(spark, d, [("V1", 0.2, 21)]).withColumn("era", F.when(F.year("date") < 1999, "early").otherwise("late"))
    return rounded(PF.metrics(PF.backtest(rows, [*_KEYS, "era"]), [*_KEYS, "era"]), "era", *_METRICS)


@query("SELECT " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_p{n}" for c, q, n in (("sharpe", 0.05, "05"), ("sharpe", 0.5, "50"), ("sharpe", 0.95, "95"), ("cagr", 0.5, "50"), ("cagr", 0.95, "95"))) + " FROM wmet", variants=_values([("V1", 0.2, 21)]))
def rotation_null(spark, d):
    """Metrics of 2,000 rotations of the tilt; their distribution is the null."""
    rows = kept(_tilts(spark, d, [("V1", 0.2, 21)]).select("session", "date", "px", "bond_ret", "tilt"))
    return rounded(PF.null_points(PF.metrics(PF.backtest(PF.rotations(rows, ROTATIONS), ["draw"]), ["draw"])), "sharpe_p05", "sharpe_p50", "sharpe_p95", "cagr_p50", "cagr_p95")


# comparisons


@query("SELECT key, count(*) AS n, round(corr(x, y), 6) AS corr_level, round(corr(dx, dy), 6) AS corr_change, round(median(x - y), 6) AS median_diff, round(quantile_cont(abs(x - y), 0.95), 6) AS p95_abs_diff, round(median(abs(y)) / median(abs(x)), 6) AS scale_ratio FROM (SELECT *, x - lag(x) OVER (PARTITION BY key ORDER BY date) AS dx, y - lag(y) OVER (PARTITION BY key ORDER BY date) AS dy FROM (SELECT key, date, value AS x, CAST(volume AS DOUBLE) * 100 AS y FROM vcells)) GROUP BY 1")
def pair_stats(spark, d):
    c = D.cells(spark, d).groupBy((F.col("ticker") % 5).alias("key"), "date").agg(F.sum("px").cast("double").alias("value"), F.sum("volume").alias("volume"))
    return rounded(C.pair_stats(c.select("key", "date", "value"), c.select("key", "date", (F.col("volume").cast("double") * 100).alias("value"))), "key", "n", "corr_level", "corr_change", "median_diff", "p95_abs_diff", "scale_ratio")


@query("SELECT key, CAST(session AS BIGINT) AS session FROM starts2")
def episode_starts(spark, d):
    return rounded(_sides(spark, d, 4)[1], "key", "session")


def event_match_5(spark, d):
    """Greedy matches within 5 hours, and what has none."""
    _, a, b = _sides(spark, d, 4)
    kind = F.when(F.col("b").isNull(), "a").when(F.col("a").isNull(), "b").otherwise("both")
    return C.match_events(a, b).select("key", kind.alias("kind"), F.coalesce("a", "b").alias("session"), F.coalesce(F.col("b") - F.col("a"), F.lit(0)).cast("long").alias("apart"))


def one_sided_events(spark, d):
    flags, a, b = _sides(spark, d, 7)
    return rounded(C.one_sided(a, b, flags.groupBy("key").agg(F.max("session").alias("last"))), "key", "side", "session", "pending")


QUERIES |= {"event_match_5": event_match_5, "one_sided_events": one_sided_events}


def _matching(shift: int, rest: str) -> str:
    """Lists of both sides' events, the greedy matches of a with b (m), and those of what is left of b with all of a (m2): each step takes the next event, and the nearest within 5 that isn't taken, the earlier of equals."""

    def steps(name: str, xs: str, ys: str) -> str:
        best = f"list_sort(list_transform(list_filter({ys}, lambda y: NOT list_contains(used, y)), lambda y: {{'d': abs(y - {xs}[i + 1]), 'y': y}}))[1]"
        return f"{name} AS (SELECT key, 0 AS i, CAST([] AS INTEGER[]) AS used, CAST([] AS VARCHAR[]) AS pairs, CAST([] AS INTEGER[]) AS hit FROM {name}0 UNION ALL SELECT key, i + 1, CASE WHEN near.d <= 5 THEN list_append(used, near.y) ELSE used END, CASE WHEN near.d <= 5 THEN list_append(pairs, x || ':' || near.y) ELSE pairs END, CASE WHEN near.d <= 5 THEN list_append(hit, x) ELSE hit END FROM (SELECT s.key, i, used, pairs, hit, {xs}[i + 1] AS x, {best} AS near FROM {name} s JOIN {name}0 l ON l.key = s.key WHERE i < len({xs})))"

    starts = sql("SELECT key, CAST(session AS INTEGER) AS session FROM starts2")
    done = lambda name, xs: f"{name}d AS (SELECT s.*, l.a, l.b FROM {name} s JOIN {name}0 l ON l.key = s.key WHERE i = len({xs}))"
    return f"""WITH RECURSIVE e AS MATERIALIZED ({starts}), f AS MATERIALIZED (SELECT DISTINCT key, CASE WHEN session % 3 = 0 THEN session + {shift} ELSE session - 1 END AS session FROM e),
    m0 AS MATERIALIZED (SELECT x.key, x.a, y.b FROM (SELECT key, list(session ORDER BY session) AS a FROM e GROUP BY 1) x JOIN (SELECT key, list(session ORDER BY session) AS b FROM f GROUP BY 1) y ON y.key = x.key),
    {steps("m", "a", "b")}, {done("m", "a")},
    left_ AS MATERIALIZED (SELECT key, pairs, a, b, list_filter(a, lambda x: NOT list_contains(hit, x)) AS ua, list_filter(b, lambda y: NOT list_contains(used, y)) AS ub FROM md),
    n0 AS MATERIALIZED (SELECT key, ub AS a, a AS b FROM left_), {steps("n", "a", "b")}, {done("n", "a")} {rest}"""


ORACLE_SQL["event_match_5"] = _matching(4, "SELECT key, 'both' AS kind, CAST(split_part(p, ':', 1) AS BIGINT) AS session, CAST(split_part(p, ':', 2) AS BIGINT) - CAST(split_part(p, ':', 1) AS BIGINT) AS apart FROM (SELECT key, unnest(pairs) AS p FROM left_) UNION ALL SELECT key, 'a', CAST(unnest(ua) AS BIGINT), 0 FROM left_ UNION ALL SELECT key, 'b', CAST(unnest(ub) AS BIGINT), 0 FROM left_")
_ends = sql("SELECT key, max(session) AS last FROM hours GROUP BY 1")
ORACLE_SQL["one_sided_events"] = _matching(7, f"SELECT o.key, o.side, CAST(o.session AS BIGINT) AS session, z.last - o.session <= 5 AS pending FROM (SELECT key, 'self' AS side, unnest(ua) AS session FROM left_ UNION ALL SELECT n.key, 'vendor', unnest(list_filter(n.a, lambda x: NOT list_contains(n.hit, x))) FROM nd n) o JOIN ({_ends}) z ON z.key = o.key")


@query("SELECT date FROM (SELECT date, pct_above > 0.5 AS x, high_ratio > 0.5 AS y, row_number() OVER (ORDER BY date DESC) AS k FROM ln WHERE pct_above IS NOT NULL AND high_ratio IS NOT NULL) WHERE k <= 90 AND x <> y")
def flag_mismatch_tail(spark, d):
    df = _lines(spark, d).where("pct_above is not null and high_ratio is not null")
    flag = lambda c: df.select(F.col("universe").alias("key"), "date", (F.col(c) > 0.5).alias("flag"))
    return C.tail_mismatches(flag("pct_above"), flag("high_ratio"), 90).select("date")


@query("SELECT count(*) AS n, round(avg(CASE WHEN d1_on = d3_on THEN 1e0 ELSE 0e0 END), 6) AS agreement FROM comp")
def flag_agreement(spark, d):
    df = _comp(spark, d)
    flag = lambda c: df.select(F.col("universe").alias("key"), "date", F.col(c).alias("flag"))
    return rounded(C.flag_agreement(flag("d1_on"), flag("d3_on")), "n", "agreement")


def _edge(spark, d):
    """The composite as deployed, and a candidate that ends three sessions earlier and differs in every third."""
    a = _comp(spark, d).select("universe", "session", "date", *C.EDGE_FIELDS)
    end = a.groupBy("universe").agg(F.max("session").alias("end"))
    other = a.withColumn("d2_on", F.when(F.col("session") % 3 == 0, ~F.col("d2_on")).otherwise(F.col("d2_on"))).join(end, "universe").where("session <= end - 3")
    return a, other.drop("end")


_edge_sql = "(SELECT a.date, a.session, a.d2_on AS x, CASE WHEN a.session % 3 = 0 THEN NOT a.d2_on ELSE a.d2_on END AS y, row_number() OVER (ORDER BY a.date DESC) AS k, count(*) OVER () AS n FROM comp a WHERE a.session <= (SELECT max(session) - 3 FROM comp))"


@query(f"SELECT date, 'd2_on' AS field, CAST(CASE WHEN x THEN 1 ELSE 0 END AS BIGINT) AS deployed, CAST(CASE WHEN y THEN 1 ELSE 0 END AS BIGINT) AS candidate FROM {_edge_sql} WHERE k <= 10 AND n >= 10 AND x <> y")
def edge_compare(spark, d):
    return rounded(C.edge_compare(*_edge(spark, d)), "date", "field", "deployed", "candidate")


@query(f"SELECT max(least(n, 10)) AS days_compared, bool_or(n < 10) AS insufficient_overlap, count(*) FILTER (k <= 10 AND n >= 10 AND x <> y) AS mismatches, count(DISTINCT CASE WHEN k <= 10 AND n >= 10 AND x <> y THEN date END) AS mismatch_days FROM {_edge_sql}")
def edge_summary(spark, d):
    return rounded(C.edge_summary(*_edge(spark, d)), "days_compared", "insufficient_overlap", "mismatches", "mismatch_days")


@query("SELECT key, round(max(value) / CASE WHEN max(value) > 1.5 THEN 100 ELSE 1 END, 6) AS top FROM vcells GROUP BY 1")
def unit_detection(spark, d):
    c = D.cells(spark, d).groupBy((F.col("ticker") % 5).alias("key"), "date").agg(F.sum("px").cast("double").alias("value"))
    return rounded(C.in_units(c).groupBy("key").agg(F.max("value").alias("top")), "key", "top")


# guards


_late, _early = "ticker % 3 = 0 AND date >= DATE '2001-01-01'", "ticker % 4 = 1 AND date < DATE '1995-03-01'"


@query(f"SELECT CAST(ticker AS VARCHAR) AS symbol, count(*) FILTER ({_late}) AS only_a, count(*) FILTER ({_early}) AS only_b FROM cells WHERE NOT ({_late} AND {_early}) GROUP BY ticker HAVING count(*) FILTER ({_late}) + count(*) FILTER ({_early}) > 0")
def basis_integrity(spark, d):
    c = D.cells(spark, d).select(F.col("ticker").cast("string").alias("symbol"), "date", "ticker")
    late, early = (F.expr(x.replace("DATE ", "date")) for x in (_late, _early))
    both = c.where(~early).withColumn("basis", F.lit("TOTALRETURN")).union(c.where(~late).withColumn("basis", F.lit("NONE")))
    return rounded(G.basis_gaps(both, "TOTALRETURN", "NONE"), "symbol", "only_a", "only_b")


@query("SELECT CAST(ticker AS VARCHAR) AS symbol, date, px, volume FROM cells WHERE ticker % 4 > 0")
def total_return_panel(spark, d):
    c = D.cells(spark, d).select(F.col("ticker").cast("string").alias("symbol"), "date", F.col("px").alias("close"), "volume", "ticker")
    both = c.withColumn("basis", F.lit("TOTALRETURN")).union(c.where("ticker % 4 > 0").withColumn("basis", F.lit("NONE")))
    return D.total_return_panel(both).select("symbol", "date", F.col("close").alias("px"), "volume")


@query("SELECT symbol, CAST(min(pos) AS BIGINT) AS pos FROM (SELECT replace(trim(' ' || p_brand || CASE WHEN p_size % 2 = 0 THEN '.B ' ELSE '-B' END), '.', '-') AS symbol, p_partkey AS pos FROM part) GROUP BY 1")
def symbol_normalise(spark, d):
    part = D.table(spark, d, "part").select(F.concat(F.lit(" "), "p_brand", F.when(F.col("p_size") % 2 == 0, ".B ").otherwise("-B")).alias("symbol"), F.col("p_partkey").alias("pos"))
    return rounded(G.current_members(part, "symbol", "pos"), "symbol", "pos")


@query("SELECT p_brand AS base, count(*) AS uses FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY 1 HAVING count(*) > 1")
def base_ticker_collisions(spark, d):
    part = D.table(spark, d, "part").select(F.concat(F.regexp_replace("p_brand", "#", "_"), F.lit("-"), (F.col("p_size") + 1000).cast("string")).alias("symbol"), "p_brand").distinct()
    out = G.collisions(part.select("symbol")).join(part.select(F.regexp_replace("p_brand", "#", "_").alias("base"), "p_brand").distinct(), "base")
    return rounded(out.select(F.col("p_brand").alias("base"), "uses"), "base", "uses")


_rosters = """SELECT CASE WHEN s.n = 0 THEN 'the source is empty' WHEN s.n < c.n THEN 'the source is shorter' WHEN s.last < c.last THEN 'the source is older' WHEN s.hollow > 0 THEN 'the source has an empty snapshot' ELSE 'ok' END AS reason, s.roster FROM (
    SELECT roster, count(m) AS n, max(m) AS last, count(*) FILTER (k = 0) AS hollow FROM (
      SELECT 'same' AS roster, m, k FROM snapm UNION ALL SELECT 'fewer', m, k FROM snapm WHERE m > (SELECT min(m) FROM snapm)
      UNION ALL SELECT 'earlier', CASE WHEN m = (SELECT max(m) FROM snapm) THEN m - 3 ELSE m END, k FROM snapm
      UNION ALL SELECT 'hollow', m, CASE WHEN m = (SELECT max(m) FROM snapm) THEN 0 ELSE k END FROM snapm UNION ALL SELECT 'none', NULL, NULL) GROUP BY 1) s
    CROSS JOIN (SELECT count(*) AS n, max(m) AS last FROM snapm) c"""


@query(_rosters)
def roster_validation(spark, d):
    snaps = kept(_members(spark, d).groupBy(F.trunc("date", "MM").cast("date").alias("snapshot_date")).agg(F.count_distinct("ticker").cast("int").alias("n_tickers")))  # a row for each month
    last, first = snaps.agg(F.max("snapshot_date").alias("last")), snaps.agg(F.min("snapshot_date").alias("first"))
    named = lambda df, name: df.select(F.lit(name).alias("roster"), "snapshot_date", "n_tickers")
    fewer = snaps.join(first, F.col("snapshot_date") == F.col("first"), "left_anti")
    earlier = snaps.join(last, F.col("snapshot_date") == F.col("last"), "left").select(F.when(F.col("last").isNotNull(), F.date_sub("snapshot_date", 3)).otherwise(F.col("snapshot_date")).alias("snapshot_date"), "n_tickers")
    hollow = snaps.join(last, F.col("snapshot_date") == F.col("last"), "left").select("snapshot_date", F.when(F.col("last").isNotNull(), 0).otherwise(F.col("n_tickers")).alias("n_tickers"))
    none = first.select(F.lit(None).cast("date").alias("snapshot_date"), F.lit(None).cast("int").alias("n_tickers"))
    names = ["same", "fewer", "earlier", "hollow", "none"]
    source = named(snaps, "same").union(named(fewer, "fewer")).union(named(earlier, "earlier")).union(named(hollow, "hollow")).union(named(none, "none"))
    current = snaps.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("roster"), "snapshot_date", "n_tickers")
    return G.roster_reason(source, current)


@query("SELECT CAST(s_suppkey AS BIGINT) AS probe, CASE WHEN s_acctbal < 0 THEN 'not ready' ELSE concat_ws('|', CASE WHEN s_nationkey > 7 THEN 'store is old' END, CASE WHEN s_suppkey % 4 = 0 THEN 'history lost reach' END, CASE WHEN s_acctbal * 3 < 15000 THEN 'delisted archive is thin' END) END AS failures FROM supplier")
def depth_guard(spark, d):
    s = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("probe"), (F.col("s_acctbal") >= 0).alias("ready"), F.col("s_nationkey").alias("age_days"), F.when(F.col("s_suppkey") % 4 == 0, F.lit("1991-01-02")).otherwise("1950-01-03").cast("date").alias("first_date"), (F.col("s_acctbal") * 3).alias("delisted"))
    return rounded(G.depth_failures(s).select("probe", F.array_join("failures", "|").alias("failures")), "probe", "failures")


@query("SELECT CAST(o_orderkey AS BIGINT) AS payload, CASE WHEN o_orderkey % 11 = 0 THEN 'no as_of' ELSE concat_ws('|', CASE WHEN o_orderkey % 6 > 3 THEN 'as_of lags' END, CASE WHEN o_orderkey % 5 = 0 THEN 'window did not extend' END, CASE WHEN o_orderstatus <> 'O' THEN 'membership was not applied' END, CASE WHEN o_custkey < 400 THEN 'valid_count below floor' END, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'wrong layer' END, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 = 0 THEN 'history shortened' END, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 60 > 45 THEN 'roster is old' END) END AS failures FROM orders")
def payload_guard(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = D.table(spark, d, "orders").select(
        k.alias("payload"), F.when(k % 11 != 0, day).alias("as_of"), (k % 6).alias("lag"), F.when(k % 7 == 0, F.lit("1995-01-01")).otherwise("1990-12-28").cast("date").alias("window_start"),
        F.when(k % 5 == 0, F.date_sub(day, 1)).otherwise(day).alias("window_end"), (F.col("o_orderstatus") != "O").alias("survivorship_bias"), F.col("o_custkey").alias("valid_count"), F.lit(400).alias("floor"),
        F.when(k % 2 == 0, "vendor").otherwise("snapshot").alias("provider"), F.when(k % 3 == 0, "other").otherwise("pit").alias("layer"), (k % 60).alias("roster_age"),
    )
    return rounded(G.payload_failures(rows).select("payload", F.array_join("failures", "|").alias("failures")), "payload", "failures")


@query("SELECT v.name, (SELECT count(*) FROM cal c WHERE c.date > CAST(v.d AS DATE) AND c.date <= CAST(v.n AS DATE)) AS lag FROM (VALUES ('week', '1999-03-01', '1999-03-08'), ('none', '1999-03-01', '1999-03-01'), ('ahead', '2001-11-01', '2002-02-01')) AS v(name, d, n)")
def session_lag(spark, d):
    rows = spark.createDataFrame([("week", "1999-03-01", "1999-03-08"), ("none", "1999-03-01", "1999-03-01"), ("ahead", "2001-11-01", "2002-02-01")], "name string, date string, now string")
    return rounded(G.session_lag(rows.select("name", F.to_date("date").alias("date"), F.to_date("now").alias("now")), D.calendar(D.cells(spark, d))), "name", "lag")


@query("SELECT count(DISTINCT last) AS stamps, CAST(max(date_diff('day', last, DATE '2001-11-20')) AS BIGINT) AS drift_days, max(date_diff('day', last, DATE '2001-11-20')) > 10 AS warn FROM (SELECT ticker, max(date) AS last FROM cells GROUP BY 1)")
def staleness_check(spark, d):
    stamps = D.cells(spark, d).groupBy(F.col("ticker").alias("symbol")).agg(F.max("date").alias("stamp"))
    return rounded(G.staleness(stamps, F.lit("2001-11-20").cast("date")), "stamps", "drift_days", "warn")


@query("SELECT (SELECT count(DISTINCT ticker) FROM cells) AS expected, (SELECT count(DISTINCT ticker) FROM cells WHERE ticker % 20 = 7) AS missing, (SELECT count(DISTINCT ticker) FROM cells WHERE ticker % 20 = 7) <= 0.05 * (SELECT count(DISTINCT ticker) FROM cells) AS ok")
def completeness(spark, d):
    symbols = D.cells(spark, d).select("universe", F.col("ticker").alias("symbol"))
    return rounded(G.completeness(symbols, symbols.where("symbol % 20 <> 7")), "expected", "missing", "ok")


@query("SELECT min(n) AS min_members, CAST(median(n) AS DOUBLE) AS median_members, max(n) AS max_members, count(*) AS days FROM (SELECT session, count(*) AS n FROM memb GROUP BY 1)")
def live_panel_quality(spark, d):
    return rounded(G.members_per_day(_members(spark, d).groupBy("universe", "session").agg(F.count("*").alias("n"))), "min_members", "median_members", "max_members", "days")
