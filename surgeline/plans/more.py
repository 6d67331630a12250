"""Queries of whole studies, documents and stores, with DuckDB SQL that says the same."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgeline.functions.chains import place
from surgeline.operators import breadth as B
from surgeline.operators import compare as C
from surgeline.operators import guards as G
from surgeline.operators import portfolio as PF
from surgeline.operators import replication as RP
from surgeline.operators import report as RE
from surgeline.operators import stress as ST
from surgeline.operators import study as E
from surgeline.params import HORIZONS, RELAXED, THRESHOLDS, TiltParams
from surgeline.plans.oracle import TABLES, r, sql
from surgeline.plans.queries import DRAWS, ORACLE_SQL, QUERIES, _bench, _bonds, _comp, _daily, _greedy, _level, _lines, _panel, _study, _tilts, kept, query, released, rounded
from surgeline.sources import panel as D
from surgeline.sources import store as ST_

P, T = RELAXED, TiltParams()
HEADLINE = ("V1", 0.2, 21)


def clone(prefix: str, names: list[str], swap: dict[str, str] | None = None) -> None:
    """Copies tables under a prefix; in the copies, each names its copied fellows, and what swap says instead of others."""
    to = {n: prefix + n for n in names} | (swap or {})
    for n in names:
        TABLES[prefix + n] = re.sub(r"\b(" + "|".join(to) + r")\b", lambda m: to[m[1]], TABLES[n])


_SIM = ["legs", "legs2", "sim", "rets", "met0", "met"]
TABLES["ctilts"] = "SELECT v.variant, 0e0 AS delta, 0 AS hold, session, v.tilt FROM cal CROSS JOIN (VALUES ('base_60_40', 0e0), ('buy_and_hold', 4e-1)) AS v(variant, tilt)"
clone("c", _SIM, {"tilts": "ctilts"})
_ERA = "CASE WHEN b.date < DATE '1999-01-01' THEN 'early' WHEN b.date < DATE '2001-06-01' THEN 'late' ELSE 'short' END"
TABLES["gtilts0"] = f"SELECT {_ERA} AS variant, t.hold, t.session AS orig, t.tilt, row_number() OVER (PARTITION BY {_ERA} ORDER BY t.session) AS session FROM tilts t JOIN bonds b ON b.session = t.session"
TABLES["gtilts"] = "SELECT variant, 2e-1 AS delta, hold, orig, tilt, session FROM gtilts0 UNION ALL SELECT variant, 0e0, hold, orig, 0e0, session FROM gtilts0"
for _t in _SIM:
    TABLES["g" + _t] = re.sub(r"\be(tilts|legs|legs2|sim|rets|met0|met)\b", r"g\1", TABLES["e" + _t])

# days that count: only data_ok, numbered anew, the benchmark carried forward over its holes
_CHAIN = ["det", "mem", "num", "comp"]
_BACK = ["fw", "sig", "pos", "blocks", "x1", "x2", "x3", "x4", "starts", "drawn", "bline", "lifted", "yields", "bonds", "tsig", "tv", "tilts", *_SIM]
_COND = TABLES["cond"].replace("JOIN fwd f", "JOIN fw f").replace(", f.mdd FROM", " FROM").replace("quantile_cont(f.mdd, 0.5)", "CAST(NULL AS DOUBLE)")
TABLES["hbench"] = "SELECT date, px FROM bench WHERE session % 7 <> 3"
for _p, _scale in (("y", "1e0"), ("z", "(SELECT median(valid_count) / 500e0 FROM daily WHERE valid_count > 0)")):
    TABLES[_p + "det0"] = TABLES["det0"].replace(f"mcc < {P.mcc_floor}", f"mcc < {P.mcc_floor} * {_scale}").replace(f"net_highs > {P.net_highs}", f"net_highs > {P.net_highs} * {_scale}")
    clone(_p, _CHAIN, {"det0": _p + "det0"})
    TABLES[_p + "cw"] = f"SELECT * REPLACE (CAST(row_number() OVER (ORDER BY session) AS INTEGER) AS session) FROM {_p}comp WHERE data_ok"
    TABLES[_p + "bw"] = f"SELECT c.session, c.date, last_value(b.px IGNORE NULLS) OVER (ORDER BY c.session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM {_p}cw c LEFT JOIN hbench b ON b.date = c.date"
    _names = {n: _p + n for n in ["cond", "fw", "sig", *_BACK]} | {"cw": _p + "cw", "bw": _p + "bw", "bench": _p + "bw", "comp": _p + "cw"}
    for _t in [*_BACK[:2], "cond", *_BACK[2:]]:
        TABLES[_p + _t] = re.sub(r"\b(" + "|".join(_names) + r")\b", lambda m: _names[m[1]], _COND if _t == "cond" else TABLES[_t])
_WEEK = "(SELECT * FROM {p}lifted WHERE threshold = 3 AND horizon = '1m') l, (SELECT * FROM {p}cond WHERE threshold = 3 AND horizon = '1m') c, (SELECT * FROM {p}bline WHERE horizon = '1m') b"


def _study_sql(p: str, mode: str) -> str:
    clusters = f"(SELECT coalesce(CAST(sum(fresh) AS BIGINT), 0) FROM (SELECT CASE WHEN date_diff('day', lag(b.date) OVER (ORDER BY b.date), b.date) <= 63 THEN 0 ELSE 1 END AS fresh FROM {p}sig s JOIN {p}bw b ON b.session = s.session WHERE s.event AND s.score >= 3))"
    legs = f"(SELECT sharpe FROM {p}met WHERE delta = 2e-1)"
    base = f"(SELECT sharpe FROM {p}met WHERE delta = 0)"
    tilts = f"(SELECT count(*) FROM (SELECT tilt, lag(tilt) OVER (ORDER BY session) AS before FROM {p}tilts WHERE delta = 2e-1) WHERE tilt > 0 AND NOT coalesce(before > 0, false))"
    return (
        f"SELECT '{mode}' AS mode, c.n, {clusters} AS clusters, {r('c.win_rate').replace('AS c.', 'AS ')}, {r('b.base_win_rate').replace('AS b.', 'AS ')}, l.win_beyond_noise, {r('c.median_ret').replace('AS c.', 'AS ')}, {r('b.base_median_ret').replace('AS b.', 'AS ')}, l.ret_beyond_noise, "
        f"round((c.median_ret - b.base_median_ret) * 100, 6) AS median_lift_pp, coalesce(c.median_ret > b.base_median_ret, false) AS replicates, round({legs}, 6) AS sharpe, round({base}, 6) AS base_sharpe, round({legs} - {base}, 6) AS sharpe_delta, {tilts} AS n_tilts FROM {_WEEK.format(p=p)}"
    )


def _modes(spark, d):
    """(comp, bench, bonds) of the days that count, for both modes of scale; universe names the mode."""
    lines = RP.scaled(_lines(spark, d), P).withColumn("universe", F.col("mode"))
    # date-level rows, read by every part of the study
    days = kept(RP.counted_days(B.composite(B.detectors(lines, P), P)))
    holes = _bench(spark, d).where("session % 7 <> 3").select("date", "px")
    bench = kept(RP.carried(days, holes.join(days.select("universe", "date"), "date")))
    yields = bench.withColumn("yield_pct", 3.0 + 2.0 * F.sin(F.col("session") / 90.0))
    return days, bench, PF.constant_maturity_return(yields, ["universe"])


def _replicated(spark, d) -> DataFrame:
    days, bench, legs = _modes(spark, d)
    out = RP.cell(days, bench, 3, ("1m", HORIZONS["1m"]), DRAWS).join(RP.tilt_legs(days, legs, HEADLINE), "universe")
    return out.withColumnRenamed("universe", "mode")


_CELL = ["mode", "n", "clusters", "win_rate", "base_win_rate", "win_beyond_noise", "median_ret", "base_median_ret", "ret_beyond_noise", "median_lift_pp", "replicates", "sharpe", "base_sharpe", "sharpe_delta", "n_tilts"]
_BOTH = "('V1', 2e-1, 21), ('V1', 0e0, 21)"


@query(f"{_study_sql('y', 'literal')} UNION ALL {_study_sql('z', 'sized')}", draws=DRAWS, variants=_BOTH)
def study_universe(spark, d):
    return rounded(_replicated(spark, d), *_CELL)


#: Universes of the gate: tickers by the remainder of 3; so few that a day with 5 of them counts.
_PARTS, FEW = range(3), replace(P, min_valid=5)
_WHOLE = ["cal", "panel", "wide", "daily", "base", "ema", "ln", "det0", "bench", "hbench", "zdet0", *["z" + n for n in (*_CHAIN, "cw", "bw", "cond", *_BACK)]]
for _u in _PARTS:
    TABLES[f"u{_u}cells"] = f"SELECT * FROM cells WHERE ticker % {len(_PARTS)} = {_u}"
    clone(f"u{_u}", [n for n in TABLES if n in _WHOLE], {"cells": f"u{_u}cells"})
    for _t in _WHOLE:
        TABLES[f"u{_u}{_t}"] = re.sub(rf"(valid_count (?:>=|<)) {P.min_valid}\b", rf"\1 {FEW.min_valid}", TABLES[f"u{_u}{_t}"])
_each = " UNION ALL ".join(f"SELECT '{u}' AS universe, replicates FROM ({_study_sql(f'u{u}z', 'sized')})" for u in _PARTS)


@query(f"SELECT coalesce(string_agg(universe, ',' ORDER BY universe) FILTER (replicates), '') AS replicated_in, CASE WHEN bool_or(replicates) THEN 'REPLICATED' ELSE 'NOT REPLICATED' END AS verdict FROM ({_each})", draws=DRAWS, variants=_BOTH)
def replication_gate(spark, d):
    """Three universes, each with its own calendar, benchmark and scale, in one job."""
    panel, sessions = _panel(spark, d, universe=f"s_nationkey % {len(_PARTS)}")
    lines = RP.scaled(B.lines(B.breadth(panel, sessions, FEW), FEW), FEW)
    days = kept(RP.counted_days(B.composite(B.detectors(lines.withColumn("universe", F.concat_ws("/", "universe", "mode")), FEW), FEW)))
    of = F.substring_index("universe", "/", 1)
    holes = D.benchmark(panel).where("session % 7 <> 3").select(F.col("universe").alias("of"), "date", "px")
    bench = kept(RP.carried(days, holes.join(days.select("universe", "date", of.alias("of")), ["of", "date"])))
    cells = RP.cell(days, bench, 3, ("1m", HORIZONS["1m"]), DRAWS)
    gate = RP.gate(cells.select(of.alias("universe"), F.substring_index("universe", "/", -1).alias("mode"), "replicates"))
    return gate.select(F.array_join("replicated_in", ",").alias("replicated_in"), "verdict")


@query("SELECT CAST(session AS BIGINT) AS session, date, CAST(n_dimensions AS BIGINT) AS n_dimensions FROM ycw")
def filter_slice(spark, d):
    return rounded(RP.counted_days(_comp(spark, d)), "session", "date", "n_dimensions")


@query(f"SELECT CAST(session AS BIGINT) AS session, date, {r('px')} FROM ybw")
def benchmark_filled(spark, d):
    return rounded(RP.carried(RP.counted_days(_comp(spark, d)), _bench(spark, d).where("session % 7 <> 3")), "session", "date", "px")


_METRICS = ["cagr", "vol", "sharpe", "max_dd", "years", "turnover_per_year"]


@query(f"SELECT variant AS curve, {r(*_METRICS)} FROM cmet")
def reference_curves(spark, d):
    curves = F.array(F.struct(F.lit("base_60_40").alias("curve"), F.lit(0.0).alias("tilt")), F.struct(F.lit("buy_and_hold").alias("curve"), F.lit(1.0 - T.base).alias("tilt")))
    rows = _bonds(spark, d).select("session", "date", "px", "bond_ret", F.inline(curves))
    return rounded(PF.metrics(PF.backtest(rows, ["curve"]), ["curve"]), "curve", *_METRICS)


@query("SELECT s.variant AS era, round(s.sharpe, 6) AS sharpe, round(b.sharpe, 6) AS base_sharpe, round(s.sharpe - b.sharpe, 6) AS sharpe_delta, (SELECT count(*) FROM (SELECT variant, tilt, lag(tilt) OVER (PARTITION BY variant ORDER BY session) AS before FROM gtilts0) g WHERE g.variant = s.variant AND tilt > 0 AND NOT coalesce(before > 0, false)) AS n_tilts FROM gmet s JOIN gmet b ON b.variant = s.variant WHERE s.delta > 0 AND b.delta = 0 AND (SELECT count(*) FROM gtilts0 g WHERE g.variant = s.variant) >= 500")
def era_deltas(spark, d):
    """Each era's tilted and untilted backtests start anew; eras of fewer than 500 sessions are left out."""
    era = F.when(F.col("date") < "1999-01-01", "early").when(F.col("date") < "2001-06-01", "late").otherwise("short")
    rows = _tilts(spark, d, [HEADLINE]).select(era.alias("universe"), "session", "date", "px", "bond_ret", "tilt")
    rows = rows.join(rows.groupBy("universe").agg(F.count("*").alias("sessions")).where("sessions >= 500").select("universe"), "universe")
    both = rows.select("universe", "session", "date", "px", "bond_ret", F.inline(F.array(F.struct(F.lit("signal").alias("leg"), F.col("tilt")), F.struct(F.lit("base").alias("leg"), F.lit(0.0).alias("tilt")))))
    m = PF.metrics(PF.backtest(both, ["universe", "leg"]), ["universe", "leg"]).groupBy("universe").agg(F.max(F.when(F.col("leg") == "signal", F.col("sharpe"))).alias("sharpe"), F.max(F.when(F.col("leg") == "base", F.col("sharpe"))).alias("base_sharpe"))
    out = m.join(PF.tilt_stats(rows, ["universe"]), "universe").select(F.col("universe").alias("era"), "sharpe", "base_sharpe", (F.col("sharpe") - F.col("base_sharpe")).alias("sharpe_delta"), "n_tilts")
    return rounded(out, "era", "sharpe", "base_sharpe", "sharpe_delta", "n_tilts")


_H2 = ["win_rate", "median_ret", "base_win_rate", "base_median_ret", "win_lift"]


@query("SELECT 1")
def h2_level_contrast(spark, d):
    comp, _, _, fwd = _study(spark, d)
    return rounded(RP.level_contrast(ST.quartile_events(_level(spark, d, comp)), fwd, E.baseline(fwd, DRAWS)), "kind", "horizon", "n", *_H2, "win_beyond_noise")


ORACLE_SQL["h2_level_contrast"] = _greedy(
    "SELECT k.kind, b.horizon, count(f.fwd) AS n, round(avg(CASE WHEN f.fwd > 0 THEN 1e0 WHEN f.fwd IS NOT NULL THEN 0e0 END), 6) AS win_rate, round(quantile_cont(f.fwd, 0.5), 6) AS median_ret, round(max(b.base_win_rate), 6) AS base_win_rate, round(max(b.base_median_ret), 6) AS base_median_ret, "
    "round(avg(CASE WHEN f.fwd > 0 THEN 1e0 WHEN f.fwd IS NOT NULL THEN 0e0 END) - max(b.base_win_rate), 6) AS win_lift, coalesce(avg(CASE WHEN f.fwd > 0 THEN 1e0 WHEN f.fwd IS NOT NULL THEN 0e0 END) > max(b.base_win_hi), false) AS win_beyond_noise "
    f"FROM (SELECT DISTINCT kind FROM thin) k CROSS JOIN ({sql('SELECT * FROM bline', draws=DRAWS)}) b LEFT JOIN (SELECT t.kind, w.horizon, w.fwd FROM (SELECT * FROM thin WHERE i IS NOT NULL) t JOIN ({sql('SELECT session, horizon, fwd FROM fw WHERE fwd IS NOT NULL')}) w ON w.session = t.i + 1) f ON f.kind = k.kind AND f.horizon = b.horizon GROUP BY 1, 2"
)


@query("SELECT count(*) FILTER (zweig) AS fire_days, CAST(coalesce(sum(CASE WHEN zweig AND NOT near THEN 1 ELSE 0 END), 0) AS BIGINT) AS episodes, CASE WHEN coalesce(sum(CASE WHEN zweig AND NOT near THEN 1 ELSE 0 END), 0) < 10 THEN 'CONSISTENT' ELSE 'LOOSER' END AS verdict FROM (SELECT true AS zweig, coalesce(date_diff('day', lag(date) OVER (ORDER BY date), date) <= 21, false) AS near FROM comp WHERE data_ok AND zweig AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')")
def silent_period(spark, d):
    return rounded(RP.silent_period(ST.fires(_comp(spark, d), ["zweig", "mcclellan", "deemer", "d1"]), "1996-01-01", "1999-12-31"), "fire_days", "episodes", "verdict")


_part = lambda cond: f"(SELECT t.threshold, z.horizon, count(f.fwd) AS n, avg(CASE WHEN f.fwd > 0 THEN 1e0 WHEN f.fwd IS NOT NULL THEN 0e0 END) AS win_rate, quantile_cont(f.fwd, 0.5) AS median_ret FROM th t CROSS JOIN hz z LEFT JOIN (SELECT s.score, f.horizon, f.fwd FROM sig s JOIN fw f ON f.session = s.session WHERE s.event AND f.fwd IS NOT NULL AND {cond}) f ON f.horizon = z.horizon AND f.score >= t.threshold GROUP BY 1, 2)"
_REC = ["burn_in_pp", "layer_pp", "win_pp", "median_pp"]
_abc = "(b.win_rate - a.win_rate) * 100 AS burn_in_pp, (c.win_rate - b.win_rate) * 100 AS layer_pp, (c.win_rate - a.win_rate) * 100 AS win_pp, (c.median_ret - a.median_ret) * 100 AS median_pp"


@query(f"SELECT CAST(threshold AS BIGINT) AS threshold, horizon, a_n, b_n, c_n, {r(*_REC)}, (coalesce(abs(win_pp) > 2, false) OR coalesce(abs(median_pp) > 1, false) OR abs(c_n - a_n) > 2) AS erratum FROM (SELECT a.threshold, a.horizon, a.n AS a_n, b.n AS b_n, c.n AS c_n, {_abc} FROM {_part('true')} a JOIN {_part('s.session > 1000')} c ON c.threshold = a.threshold AND c.horizon = a.horizon LEFT JOIN {_part('s.session > (SELECT min(session) FROM bw) + 251')} b ON b.threshold = a.threshold AND b.horizon = a.horizon WHERE a.horizon IN ('6m', '12m'))")
def reconcile_three(spark, d):
    """The record, the record without the events of its first 252 sessions, and a later layer."""
    _, bench, signal, fwd = _study(spark, d)
    cut = bench.groupBy("universe").agg((F.min("session") + 251).alias("cut"))  # a row for each universe
    clean = signal.join(cut, "universe").withColumn("event", F.col("event") & (F.col("session") > F.col("cut"))).drop("cut")
    study = lambda s: E.conditional(s, fwd, bench)
    return rounded(RP.reconcile_three(study(signal), study(clean), study(signal.where("session > 1000"))), "threshold", "horizon", "a_n", "b_n", "c_n", *_REC, "erratum")


@query(
    "SELECT count(*) AS overlap_days, min(date) AS overlap_start, count(*) >= 250 AS available, round(corr(p, f), 6) AS correlation, round(pow(product(1 + p), 252e0 / count(*)) - 1, 6) AS proxy_return, round(pow(product(1 + f), 252e0 / count(*)) - 1, 6) AS fund_return, "
    "round((pow(product(1 + p), 252e0 / count(*)) - pow(product(1 + f), 252e0 / count(*))) * 100, 6) AS gap_pp, round(stddev_samp(p) * sqrt(252e0), 6) AS proxy_vol, round(stddev_samp(f) * sqrt(252e0), 6) AS fund_vol FROM (SELECT b.date, b.bond_ret AS p, 0.9 * b.bond_ret + 0.0001 * (b.session % 5 - 2) AS f FROM bonds b WHERE b.session > 800)"
)
def bond_proxy_check(spark, d):
    bonds = _bonds(spark, d)
    fund = bonds.where("session > 800").select("universe", "date", (0.9 * F.col("bond_ret") + 0.0001 * (F.col("session") % 5 - 2)).alias("ret"))
    out = RP.bond_proxy(bonds.select("universe", "date", F.col("bond_ret").alias("ret")), fund)
    return rounded(out, "overlap_days", "overlap_start", "available", "correlation", "proxy_return", "fund_return", "gap_pp", "proxy_vol", "fund_vol")


_DAYS = ["win_rate", "median_ret", "mean_ret"]


@query(f"SELECT CAST(t.threshold AS BIGINT) AS threshold, z.horizon, count(f.fwd) AS n, round(avg(CASE WHEN f.fwd > 0 THEN 1e0 WHEN f.fwd IS NOT NULL THEN 0e0 END), 6) AS win_rate, round(quantile_cont(f.fwd, 0.5), 6) AS median_ret, round(avg(f.fwd), 6) AS mean_ret FROM th t CROSS JOIN hz z LEFT JOIN (SELECT s.score, f.horizon, f.fwd FROM sig s JOIN fw f ON f.session = s.session WHERE f.fwd IS NOT NULL) f ON f.horizon = z.horizon AND f.score >= t.threshold GROUP BY 1, 2")
def conditional_all_days(spark, d):
    """Every day with the score, not only events."""
    _, bench, signal, fwd = _study(spark, d)
    return rounded(E.conditional(signal, fwd, bench, THRESHOLDS, events_only=False), "threshold", "horizon", "n", *_DAYS)


@query("SELECT CAST(l.threshold AS BIGINT) AS threshold, l.horizon, l.n, round(l.win_lift, 6) AS win_lift, coalesce(c.clusters, 0) AS clusters FROM lifted l LEFT JOIN (SELECT threshold, CAST(sum(fresh) AS BIGINT) AS clusters FROM (SELECT t.threshold, CASE WHEN date_diff('day', lag(b.date) OVER (PARTITION BY t.threshold ORDER BY b.date), b.date) <= 63 THEN 0 ELSE 1 END AS fresh FROM sig s JOIN bw b ON b.session = s.session JOIN th t ON s.score >= t.threshold WHERE s.event) GROUP BY 1) c ON c.threshold = l.threshold", draws=DRAWS)
def run_study(spark, d):
    """The whole study of the valid window: lift of every cell, with the clusters of its events."""
    return rounded(E.study(*_study(spark, d)[1:], DRAWS), "threshold", "horizon", "n", "win_lift", "clusters")


# documents

TABLES["lastday"] = "SELECT * FROM (SELECT *, max(up_volume_ratio) OVER (ORDER BY session ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS best_up FROM comp) WHERE session = (SELECT max(session) FROM comp)"


@query("SELECT dimension, gauge, round(reading, 6) AS reading, arms, fires, fired, dimension_on FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS dimension, '{g}' AS gauge, CAST({x} AS DOUBLE) AS reading, CAST({'NULL' if RE.triggers(P)[g][0] is None else RE.triggers(P)[g][0]} AS DOUBLE) AS arms, CAST({RE.triggers(P)[g][1]} AS DOUBLE) AS fires, {f} AS fired, {a}_on AS dimension_on FROM lastday" for a, g, x, f in RE.GAUGES) + ")")
def formation_gauges(spark, d):
    return rounded(RE.formation(_comp(spark, d), P), "dimension", "gauge", "reading", "arms", "fires", "fired", "dimension_on")


_LAST = "(SELECT session, date FROM cw WHERE event AND n_dimensions >= 1 ORDER BY session DESC LIMIT 1)"


@query(f"SELECT e.date AS event_date, CAST(b.session - e.session - 1 AS BIGINT) AS day, round(b.px / a.px - 1, 6) AS ret FROM {_LAST} e JOIN bw a ON a.session = e.session + 1 JOIN bw b ON b.session > e.session")
def last_signal_path(spark, d):
    comp, bench, _, _ = _study(spark, d, {"1w": 5})
    return rounded(RE.signal_path(comp, bench), "event_date", "day", "ret")


@query("SELECT c.date, round(b.px, 2) AS px, CAST(c.n_dimensions AS BIGINT) AS n_dimensions, c.d1_on, c.event FROM cw c JOIN bench b ON b.session = c.session")
def filed_record(spark, d):
    """The timeline's parallel arrays, read back as rows."""
    record = RE.timeline_arrays(_comp(spark, d), _bench(spark, d))
    return rounded(RE.from_arrays(record, ["date", "px", "n_dimensions", "d1_on", "event"]), "date", "px", "n_dimensions", "d1_on", "event")


@query(
    f"SELECT x.date AS as_of, CAST(x.n_dimensions AS BIGINT) AS n_dimensions, round(x.score, 6) AS score, x.data_ok, x.valid_count, false AS survivorship_bias, CAST({P.memory} AS BIGINT) AS memory_days, CAST(7 AS BIGINT) AS gauges, (SELECT date FROM {_LAST}) AS event_date, (SELECT count(*) FROM cond) AS cells, (SELECT CAST(sum(n) AS BIGINT) FROM cond) AS events, (SELECT count(*) FROM cw) AS days, (SELECT min(date) FROM cw) AS first_day FROM lastday x"
)
def payload_document(spark, d):
    """What the document of a run holds; the document itself is written by sources.store."""
    _, bench, signal, fwd = _study(spark, d)
    doc = RE.documents(_comp(spark, d), _bench(spark, d), E.conditional(signal, fwd, bench), P, False)
    out = doc.select("current.as_of", "current.n_dimensions", "current.score", "current.data_ok", "current.valid_count", "survivorship_bias", "memory_days", F.size("formation").alias("gauges"), "last_signal.event_date", F.size("study").alias("cells"), F.aggregate("study", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("events"), F.size("timeline.date").alias("days"), F.element_at("timeline.date", 1).alias("first_day"))
    return rounded(out, *out.columns)


# sources


def _bases(spark, d):
    c = D.cells(spark, d).select(F.col("ticker").cast("string").alias("symbol"), "date", F.col("px").cast("double").alias("close"), "volume")
    return c.withColumn("basis", F.lit("TOTALRETURN")).union(c.withColumn("close", F.col("close") - 1).withColumn("basis", F.lit("NONE")))


@query("SELECT CAST(ticker AS VARCHAR) AS symbol, 'NONE' AS basis, date, CAST(px - 1 AS DOUBLE) AS close, volume, 'first' AS source_stamp FROM cells UNION ALL SELECT CAST(ticker AS VARCHAR), 'TOTALRETURN', date, CAST(px + 7 AS DOUBLE), volume, 'second' FROM cells WHERE ticker % 2 = 0")
def series_store(spark, d):
    """A store of two bases, of which one is replaced whole by a later delivery with fewer symbols."""
    path, rows = place(spark, "series"), _bases(spark, d).select("basis", "symbol", "date", "close", "volume")
    ST_.write_series(rows, path, "first")
    ST_.write_series(rows.where("basis = 'TOTALRETURN' and symbol % 2 = 0").withColumn("close", F.col("close") + 7), path, "second")
    return ST_.read_series(spark, path).select("symbol", "basis", "date", "close", "volume", "source_stamp")


@query("SELECT CAST(date_trunc('month', date) AS DATE) AS snapshot_date, CAST(ticker AS VARCHAR) AS ticker FROM cells GROUP BY 1, 2")
def snapshots_json(spark, d):
    """Membership snapshots, each month's tickers, as their JSON is written and read back."""
    months = D.cells(spark, d).groupBy(F.trunc("date", "MM").cast("date").cast("string").alias("day")).agg(F.collect_set(F.col("ticker").cast("string")).alias("tickers"))
    path = place(spark, "snapshots")
    months.select(F.create_map("day", F.struct("tickers")).alias("snapshots")).write.json(path)
    return D.read_snapshots(spark, path, lines=True).select("snapshot_date", "ticker")


@query("SELECT CAST(ticker % 3 AS VARCHAR) AS universe, count(*) AS cells, count(DISTINCT ticker) AS tickers FROM cells WHERE ticker % 3 < 2 GROUP BY 1 UNION ALL SELECT '2', 0, 0")
def merged_document(spark, d):
    """Results by universe, put into one document one after another; a later one replaces its universe's alone."""
    path = place(spark, "results")
    sums = D.cells(spark, d).groupBy((F.col("ticker") % 3).cast("string").alias("universe")).agg(F.count("*").alias("cells"), F.count_distinct("ticker").alias("tickers"))
    for r in sums.collect():  # a row for each universe
        ST_.merge_document(spark, path, r.universe, {"cells": r.cells, "tickers": r.tickers})
    document = ST_.merge_document(spark, path, "2", {"cells": 0, "tickers": 0})
    assert document == ST_.read_document(spark, path)
    return spark.createDataFrame([(u, x["cells"], x["tickers"]) for u, x in document.items()], "universe string, cells long, tickers long")


@query("SELECT date, CAST(px - 1 AS DOUBLE) AS close FROM cells WHERE ticker = 3")
def benchmark_series(spark, d):
    """One symbol's series on the unadjusted basis: a benchmark, or a vendor's indicator."""
    return ST_.series_of(_bases(spark, d), "3")


@query("SELECT a.date, CAST(a.px AS DOUBLE) AS level, CAST(b.px - 1 AS DOUBLE) AS px FROM cells a JOIN cells b ON b.date = a.date WHERE a.ticker = 3 AND b.ticker = 5")
def joint_frame(spark, d):
    rows = _bases(spark, d)
    return C.joint(ST_.series_of(rows, "3", "TOTALRETURN").withColumnRenamed("close", "level"), ST_.series_of(rows, "5").withColumnRenamed("close", "px"))


@query("SELECT ticker AS symbol, CASE WHEN ticker % 3 = 0 AND ticker % 2 = 0 THEN 'both' WHEN ticker % 3 = 0 THEN 'a' ELSE 'b' END AS part FROM (SELECT DISTINCT ticker FROM cells) WHERE ticker % 3 = 0 OR ticker % 2 = 0")
def symbol_sets(spark, d):
    s = D.cells(spark, d).select(F.col("ticker").alias("symbol")).distinct()
    return ST_.set_operations(s.where("symbol % 3 = 0"), s.where("symbol % 2 = 0"))


@query("SELECT ticker, date, px AS close, volume FROM cells")
def panel_cache(spark, d):
    """A cache of every ticker, as it is saved and loaded."""
    path = place(spark, "panel-cache")
    ST_.save_cache(D.cells(spark, d).select("ticker", "date", F.col("px").alias("close"), "volume"), path, "2026-01-01")
    return ST_.load_cache(spark, path).select(F.col("ticker").cast("long").alias("ticker"), "date", F.col("close").cast("long").alias("close"), "volume")


# guards


@query("SELECT CAST(s_suppkey AS BIGINT) AS store, CASE WHEN s_acctbal < 0 THEN 'service is down' WHEN s_nationkey % 5 = 0 THEN 'missing database: main' WHEN s_nationkey % 7 = 0 THEN 'missing database: delisted' WHEN s_suppkey % 6 = 0 THEN 'no delisted members' ELSE 'ok' END AS reason FROM supplier")
def readiness_rules(spark, d):
    s = D.table(spark, d, "supplier")
    bases = F.array_compact(F.array(F.when(F.col("s_nationkey") % 5 != 0, F.lit("main")), F.when(F.col("s_nationkey") % 7 != 0, F.lit("delisted"))))
    rows = s.select(F.col("s_suppkey").alias("store"), (F.col("s_acctbal") >= 0).alias("running"), bases.alias("databases"), (F.col("s_suppkey") % 6).alias("delisted"))
    return rounded(G.readiness(rows, ["main", "delisted"]), "store", "reason")


_sync = "(SELECT max(snapshot_date) FROM snaps)"
_count = "(SELECT count(DISTINCT snapshot_date) FROM snaps)"


@query(f"SELECT 'longer' AS roster, 'synced' AS outcome, CAST({_sync} + 31 AS DATE) AS in_force UNION ALL SELECT 'same', 'current', {_sync} UNION ALL SELECT 'fewer', CASE WHEN {_count} > 1 THEN 'rejected' ELSE 'current' END, {_sync} UNION ALL SELECT 'none', 'rejected', {_sync}")
def roster_sync(spark, d):
    cells = D.cells(spark, d)
    months = cells.groupBy(F.add_months(F.trunc("date", "MM"), 1).cast("date").alias("snapshot_date")).agg(F.least(F.count_distinct("ticker"), F.lit(15)).cast("int").alias("n_tickers"))
    ends = months.agg(F.max("snapshot_date").alias("last"), F.min("snapshot_date").alias("first"))
    named = lambda df, name: df.select(F.lit(name).alias("roster"), "snapshot_date", "n_tickers")
    more = ends.select(F.date_add("last", 31).alias("snapshot_date"), F.lit(9).alias("n_tickers"))
    none = ends.select(F.lit(None).cast("date").alias("snapshot_date"), F.lit(None).cast("int").alias("n_tickers"))
    fewer = months.join(ends.select(F.col("first").alias("snapshot_date")), "snapshot_date", "left_anti")
    source = named(months.union(more), "longer").union(named(months, "same")).union(named(fewer, "fewer")).union(named(none, "none"))
    current = months.select(F.explode(F.array(*[F.lit(x) for x in ("longer", "same", "fewer", "none")])).alias("roster"), "snapshot_date", "n_tickers")
    return G.sync(source, current).select("roster", "outcome", "in_force")


def _vendor(spark, d):
    """The counts of another source: the same, but for some days."""
    daily = _daily(spark, d).select("universe", "session", "date", "advances", "declines")
    return daily, daily.withColumn("advances", F.when(F.col("session") % 13 == 0, F.col("advances") + 6).otherwise(F.col("advances")))


TABLES["vbase"] = "SELECT session, date, CAST(a AS DOUBLE) / nullif(a + d, 0) AS x, a, d FROM (SELECT session, date, CASE WHEN session % 13 = 0 THEN advances + 6 ELSE advances END AS a, declines AS d FROM daily)"
TABLES["vema"] = f"SELECT session, x AS z FROM vbase WHERE session = 1 UNION ALL SELECT b.session, CASE WHEN e.z IS NULL THEN b.x WHEN b.x IS NULL THEN e.z ELSE (1 - 2e0 / {P.zweig_span + 1}) * e.z + (2e0 / {P.zweig_span + 1}) * b.x END FROM vema e JOIN vbase b ON b.session = e.session + 1"


@query(f"SELECT CAST(b.session AS BIGINT) AS session, round(e.z, 6) AS zweig_line, coalesce(CASE WHEN b.session >= 10 THEN CAST(sum(a) OVER w AS DOUBLE) / nullif(sum(d) OVER w, 0) END > {P.deemer_ratio}, false) AS deemer FROM vbase b JOIN vema e ON e.session = b.session WINDOW w AS (ORDER BY b.session ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def raw_count_lines(spark, d):
    """The lines that need advances and declines alone."""
    return rounded(C.count_lines(_vendor(spark, d)[1], P), "session", "zweig_line", "deemer")


@query("SELECT date, round(abs(own - other), 6) AS diff, k <= 10 AS recent FROM (SELECT l.date, l.zweig_line AS own, e.z AS other, row_number() OVER (ORDER BY l.date DESC) AS k FROM ln l JOIN vema e ON e.session = l.session WHERE l.zweig_line IS NOT NULL AND e.z IS NOT NULL) WHERE abs(own - other) > 0.02")
def zweig_tolerance(spark, d):
    """Days of the whole history on which the sources' lines are apart; those of the last ten, which the guard alerts to, are marked."""
    a, b = (C.count_lines(x, P).select(F.col("universe").alias("key"), "date", F.col("zweig_line").alias("value")) for x in _vendor(spark, d))
    return rounded(C.all_apart(a, b, 0.02, 10), "date", "diff", "recent")


@query("SELECT CAST(o_orderkey AS BIGINT) AS stamp, CAST(greatest(floor((date_diff('second', o_orderdate, o_orderdate + to_hours(CAST(o_orderkey % 100 AS BIGINT))) + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 8 * 3600 END) / 86400), 0) AS BIGINT) AS age FROM orders")
def stamp_age_days(spark, d):
    """Ages of stamps with a zone (every third) and without, which count as Singapore's."""
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("stamp"), F.col("o_orderdate").alias("at"))
    text = F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("stamp") % 3 == 0, "Z").otherwise(""))
    now = F.timestamp_seconds(F.unix_timestamp("at") + F.col("stamp") % 100 * 3600)
    return rounded(o.select("stamp", G.age_days(text, now).alias("age")), "stamp", "age")


@query("SELECT CAST(p_partkey AS BIGINT) AS part, regexp_replace(p_type || ':' || p_brand || '?', '[<>:\"/\\\\|?*]', '_', 'g') AS name FROM part")
def safe_names(spark, d):
    p = D.table(spark, d, "part").select(F.col("p_partkey").alias("part"), G.safe_name(F.concat("p_type", F.lit(":"), "p_brand", F.lit("?"))).alias("name"))
    return rounded(p, "part", "name")


@query("SELECT universe, CAST(missing AS BIGINT) AS missing, missing <= 0.05 * expected AS ok FROM (SELECT 'few' AS universe, count(*) AS expected, count(*) FILTER (ticker % 100 = 7) AS missing FROM (SELECT DISTINCT ticker FROM cells) UNION ALL SELECT 'many', count(*), count(*) FILTER (ticker % 4 = 1) FROM (SELECT DISTINCT ticker FROM cells))")
def panel_refusal(spark, d):
    """Which panels would be refused, as too many names are missing."""
    s = D.cells(spark, d).select(F.col("ticker").alias("symbol")).distinct()
    named = lambda df, n: df.select(F.lit(n).alias("universe"), "symbol")
    out = G.completeness(named(s, "few").union(named(s, "many")), named(s.where("symbol % 100 <> 7"), "few").union(named(s.where("symbol % 4 <> 1"), "many")))
    return rounded(out, "universe", "missing", "ok")


_noise = "(((t.range * 48271 + s.range * 16807 + 7) * 48271) % 2147483647 * 69621) % 2147483647"


@query(
    f"SELECT session, count(*) FILTER (px > prev) AS advances, count(*) FILTER (px < prev) AS declines, CAST(sum(volume) AS BIGINT) AS volume, round(avg(px), 3) AS mean_px FROM (SELECT *, lag(px) OVER (PARTITION BY ticker ORDER BY session) AS prev FROM (SELECT session, ticker, volume, 100 * exp(sum(step) OVER (PARTITION BY ticker ORDER BY session)) AS px FROM ("
    f"SELECT t.range AS ticker, s.range AS session, 1000 + {_noise} % 9000 AS volume, ({_noise} % 20001 - 10000) / 10000e0 * 0.017 + CASE WHEN s.range BETWEEN 300 AND 311 OR s.range BETWEEN 900 AND 911 THEN 0.02 WHEN s.range BETWEEN 260 AND 299 OR s.range BETWEEN 860 AND 899 THEN -0.01 ELSE 0 END AS step FROM range(480) t CROSS JOIN range(1, 1501) s))) GROUP BY 1"
)
def synthetic_run(spark, d):
    """The generated panel of 1,500 sessions and 480 tickers, by session."""
    panel = D.synthetic(spark)
    sessions = panel.select("universe", "session", "date").distinct()
    daily = B.breadth(panel, sessions, P).select("session", "advances", "declines")
    means = panel.groupBy("session").agg(F.sum("volume").alias("volume"), F.round(F.avg("px"), 3).alias("mean_px"))
    return rounded(daily.join(means, "session"), "session", "advances", "declines", "volume", "mean_px")


QUERIES.update({name: released(f) for name, f in QUERIES.items()})
