"""The same queries in DuckDB SQL, written independently of the DataFrame code."""

from __future__ import annotations

from surgeline.params import HORIZONS, RELAXED, TiltParams

P, T = RELAXED, TiltParams()
N = {"ma": P.ma_window, "hl": P.high_low_window}
HS = ", ".join(f"('{k}', {v})" for k, v in HORIZONS.items())


def any_in(flag: str, n: int, w: str = "ORDER BY session") -> str:
    return f"coalesce(bool_or({flag}) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), false)"


def crossed(x: str, low: float, high: float, n: int) -> str:
    return f"(coalesce({x} > {high}, false) AND {any_in(f'coalesce({x} < {low}, false)', n)})"


#: Named tables; each may use those before it.
TABLES: dict[str, str] = {
    "cells": """SELECT CAST(s_nationkey AS BIGINT) AS ticker, CAST(l_shipdate AS DATE) AS date,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) // CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS px,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "cal": "SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS session FROM (SELECT DISTINCT date FROM cells)",
    "panel": """SELECT session, date, ticker, px, volume FROM (
        SELECT c.session, c.date, t.ticker, last_value(x.px IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY c.session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px, coalesce(x.volume, 0) AS volume
        FROM cal c CROSS JOIN (SELECT DISTINCT ticker FROM cells) t LEFT JOIN cells x ON x.date = c.date AND x.ticker = t.ticker) WHERE px IS NOT NULL""",
    "wide": f"""SELECT session, ticker, px, volume,
        max(px) OVER (PARTITION BY ticker ORDER BY session RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev,
        CASE WHEN count(px) OVER (PARTITION BY ticker ORDER BY session RANGE BETWEEN {P.ma_window - 1} PRECEDING AND CURRENT ROW) = {P.ma_window}
          THEN sum(px) OVER (PARTITION BY ticker ORDER BY session RANGE BETWEEN {P.ma_window - 1} PRECEDING AND CURRENT ROW) END AS ma_sum,
        CASE WHEN count(px) OVER (PARTITION BY ticker ORDER BY session RANGE BETWEEN {P.high_low_window - 1} PRECEDING AND CURRENT ROW) = {P.high_low_window}
          THEN max(px) OVER (PARTITION BY ticker ORDER BY session RANGE BETWEEN {P.high_low_window - 1} PRECEDING AND CURRENT ROW) END AS high,
        CASE WHEN count(px) OVER (PARTITION BY ticker ORDER BY session RANGE BETWEEN {P.high_low_window - 1} PRECEDING AND CURRENT ROW) = {P.high_low_window}
          THEN min(px) OVER (PARTITION BY ticker ORDER BY session RANGE BETWEEN {P.high_low_window - 1} PRECEDING AND CURRENT ROW) END AS low
        FROM {{panel}}""",
    "daily": f"""SELECT c.session, c.date,
        count(*) FILTER (px > prev) AS advances, count(*) FILTER (px < prev) AS declines, count(prev) AS valid_count,
        count(*) FILTER (px * {P.ma_window} > ma_sum) AS above_count, count(ma_sum) AS ma_valid_count,
        count(*) FILTER (px >= high) AS new_highs, count(*) FILTER (px <= low) AS new_lows, count(high) AS hl_valid_count,
        CAST(coalesce(sum(volume) FILTER (px > prev), 0) AS BIGINT) AS up_volume, CAST(coalesce(sum(volume) FILTER (prev IS NOT NULL), 0) AS BIGINT) AS total_volume
        FROM cal c LEFT JOIN wide w ON w.session = c.session GROUP BY 1, 2""",
    "base": """SELECT *, CAST(above_count AS DOUBLE) / nullif(ma_valid_count, 0) AS pct_above, CAST(up_volume AS DOUBLE) / nullif(total_volume, 0) AS up_volume_ratio,
        CAST(advances AS DOUBLE) / nullif(advances + declines, 0) AS ad_ratio, advances - declines AS net FROM daily""",
    "ema": f"""SELECT session, ad_ratio AS z, CAST(net AS DOUBLE) AS f, CAST(net AS DOUBLE) AS s FROM base WHERE session = 1
        UNION ALL
        SELECT b.session, CASE WHEN e.z IS NULL THEN b.ad_ratio WHEN b.ad_ratio IS NULL THEN e.z ELSE (1 - 2e0 / {P.zweig_span + 1}) * e.z + (2e0 / {P.zweig_span + 1}) * b.ad_ratio END,
          (1 - 2e0 / {P.mcc_fast + 1}) * e.f + (2e0 / {P.mcc_fast + 1}) * b.net, (1 - 2e0 / {P.mcc_slow + 1}) * e.s + (2e0 / {P.mcc_slow + 1}) * b.net
        FROM ema e JOIN base b ON b.session = e.session + 1""",
    "ln": f"""SELECT b.*, e.z AS zweig_line, e.f - e.s AS mcc,
        CASE WHEN b.session >= {P.deemer_window} THEN CAST(sum(advances) OVER (ORDER BY b.session ROWS BETWEEN {P.deemer_window - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) / nullif(sum(declines) OVER (ORDER BY b.session ROWS BETWEEN {P.deemer_window - 1} PRECEDING AND CURRENT ROW), 0) END AS deemer_ratio,
        CAST(new_highs AS DOUBLE) / nullif(new_highs + new_lows, 0) AS high_ratio, new_highs - new_lows AS net_highs
        FROM base b JOIN ema e ON e.session = b.session""",
    "det0": f"""SELECT *, {crossed('zweig_line', P.zweig_low, P.zweig_high, P.zweig_span)} AS zweig, coalesce(deemer_ratio > {P.deemer_ratio}, false) AS deemer,
        coalesce(mcc > 0, false) AND {any_in(f'coalesce(mcc < {P.mcc_floor}, false)', P.mcc_window)} AS mcclellan,
        {crossed('pct_above', P.pct_low, P.pct_high, P.pct_window)} AS d2, {crossed('high_ratio', P.ratio_low, P.ratio_high, P.ratio_window)} AS nhnl_ratio,
        coalesce(net_highs > {P.net_highs}, false) AND {any_in('coalesce(net_highs < 0, false)', P.net_window)} AS nhnl_net,
        {any_in(f'coalesce(up_volume_ratio > {P.up_volume}, false)', P.up_volume_window)} AS d4 FROM ln""",
    "det": "SELECT *, (zweig OR deemer OR mcclellan) AS d1, (nhnl_ratio OR nhnl_net) AS d3 FROM det0",
    "mem": "SELECT *, " + ", ".join(f"{any_in(f'd{k}', P.memory)} AS d{k}_on" for k in (1, 2, 3, 4)) + " FROM det",
    "num": "SELECT *, CAST(d1_on AS INTEGER) + CAST(d2_on AS INTEGER) + CAST(d3_on AS INTEGER) + CAST(d4_on AS INTEGER) AS n_dimensions FROM mem",
    "comp": f"""SELECT *, CAST(n_dimensions AS DOUBLE) AS score, n_dimensions > coalesce(lag(n_dimensions) OVER (ORDER BY session), 0) AS event,
        (ma_valid_count < {P.min_valid} OR hl_valid_count < {P.min_valid}) AS burn_in,
        (valid_count >= {P.min_valid} AND NOT (ma_valid_count < {P.min_valid} OR hl_valid_count < {P.min_valid})) AS data_ok FROM num""",
    "bench": "SELECT session, date, CAST(sum(px) AS DOUBLE) / count(px) AS px FROM panel GROUP BY 1, 2",
    "cw": "SELECT * FROM comp WHERE session BETWEEN (SELECT min(session) FROM comp WHERE data_ok) AND (SELECT max(session) FROM comp WHERE data_ok)",
    "bw": "SELECT * FROM bench WHERE session BETWEEN (SELECT min(session) FROM comp WHERE data_ok) AND (SELECT max(session) FROM comp WHERE data_ok)",
    "hz": f"SELECT * FROM (VALUES {HS}) AS v(horizon, h)",
    "path": """SELECT a.session, z.horizon, z.h, a.px AS p0, b.session - a.session AS k, b.px, max(b.px) OVER (PARTITION BY z.horizon, a.session ORDER BY b.session) AS peak
        FROM bw a CROSS JOIN hz z JOIN bw b ON b.session BETWEEN a.session AND a.session + z.h""",
    "fwd": "SELECT session, horizon, h, max(px) FILTER (k = h) / max(p0) - 1e0 AS fwd, CASE WHEN count(*) = h + 1 THEN min(px / peak - 1e0) END AS mdd FROM path GROUP BY 1, 2, 3",
    "fw": "SELECT a.session, z.horizon, z.h, b.px / a.px - 1e0 AS fwd FROM bw a CROSS JOIN hz z LEFT JOIN bw b ON b.session = a.session + z.h",
    "sig": "SELECT b.session, lag(c.n_dimensions) OVER (ORDER BY b.session) AS score, coalesce(lag(c.event) OVER (ORDER BY b.session), false) AS event FROM bw b LEFT JOIN cw c ON c.session = b.session",
    "th": "SELECT * FROM (VALUES (1), (2), (3), (4)) AS v(threshold)",
    "cond": """SELECT t.threshold, z.horizon, count(f.fwd) AS n, avg(CASE WHEN f.fwd > 0 THEN 1e0 WHEN f.fwd IS NOT NULL THEN 0e0 END) AS win_rate, quantile_cont(f.fwd, 0.5) AS median_ret, avg(f.fwd) AS mean_ret,
        quantile_cont(f.fwd, 0.1) AS p10, quantile_cont(f.fwd, 0.25) AS p25, quantile_cont(f.fwd, 0.75) AS p75, quantile_cont(f.fwd, 0.9) AS p90, quantile_cont(f.mdd, 0.5) AS median_max_dd
        FROM th t CROSS JOIN hz z LEFT JOIN (SELECT s.score, f.horizon, f.fwd, f.mdd FROM sig s JOIN fwd f ON f.session = s.session WHERE s.event AND f.fwd IS NOT NULL) f ON f.horizon = z.horizon AND f.score >= t.threshold GROUP BY 1, 2""",
    "pos": "SELECT horizon, h, fwd, CAST(row_number() OVER (PARTITION BY horizon ORDER BY session) - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY horizon) AS n FROM fw WHERE fwd IS NOT NULL",
    "blocks": """SELECT horizon, h, n, d.draw, b.b FROM (SELECT DISTINCT horizon, h, n FROM pos) CROSS JOIN (SELECT CAST(range AS BIGINT) AS draw FROM range({draws})) d JOIN (SELECT CAST(range AS BIGINT) AS b FROM range(200)) b ON b.b < greatest(n // {block}, 1)""",
    "x1": "SELECT *, (CAST(12345 AS BIGINT) * 48271 + 42 * 16807 + 7) % 2147483647 AS x FROM blocks",
    "x2": "SELECT *, (x * 48271 + CAST(h AS BIGINT) * 16807 + 7) % 2147483647 AS y FROM x1",
    "x3": "SELECT *, (y * 48271 + draw * 16807 + 7) % 2147483647 AS z FROM x2",
    "x4": "SELECT *, (((z * 48271 + b * 16807 + 7) % 2147483647) * 48271) % 2147483647 AS u FROM x3",
    "starts": "SELECT horizon, draw, n, (u * greatest(n - {block}, 1)) // 2147483647 AS start FROM x4",
    "drawn": "SELECT s.horizon, s.draw, avg(CASE WHEN p.fwd > 0 THEN 1e0 ELSE 0e0 END) AS win, quantile_cont(p.fwd, 0.5) AS med FROM starts s JOIN pos p ON p.horizon = s.horizon AND p.i >= s.start AND p.i < s.start + {block} GROUP BY 1, 2",
    "bline": """SELECT horizon, quantile_cont(win, 0.5) AS base_win_rate, quantile_cont(win, 0.05) AS base_win_lo, quantile_cont(win, 0.95) AS base_win_hi,
        quantile_cont(med, 0.5) AS base_median_ret, quantile_cont(med, 0.05) AS base_ret_lo, quantile_cont(med, 0.95) AS base_ret_hi, (SELECT count(*) FROM pos p WHERE p.horizon = d.horizon) AS n_total FROM drawn d GROUP BY horizon""",
    "lifted": """SELECT c.threshold, c.horizon, c.n, c.win_rate - b.base_win_rate AS win_lift, c.median_ret - b.base_median_ret AS ret_lift,
        coalesce(c.win_rate > b.base_win_hi, false) AS win_beyond_noise, coalesce(c.median_ret > b.base_ret_hi, false) AS ret_beyond_noise FROM cond c LEFT JOIN bline b ON b.horizon = c.horizon""",
    "yields": "SELECT session, date, px, 3e0 + 2e0 * sin(session / 90e0) AS yield_pct FROM bench",
    "bonds": """SELECT session, date, px, coalesce(yb / 2 * (1 - pow(1 + y / 2, -(10 - 1e0 / 252) * 2)) / nullif(y / 2, 0) + pow(1 + y / 2, -(10 - 1e0 / 252) * 2) - 1 + yb / 252, 0) AS bond_ret
        FROM (SELECT session, date, px, yield_pct / 100 AS y, lag(yield_pct) OVER (ORDER BY session) / 100 AS yb FROM yields)""",
    "tsig": "SELECT session, lag(event) OVER (ORDER BY session) AS event, lag(n_dimensions) OVER (ORDER BY session) AS score FROM comp",
    "tv": """SELECT v.variant, v.delta, v.hold, s.session, last_value(CASE WHEN s.event AND s.score >= CASE v.variant WHEN 'V1' THEN 3 ELSE 1 END THEN s.session END IGNORE NULLS) OVER w AS fired,
        last_value(CASE WHEN s.event AND s.score >= CASE v.variant WHEN 'V1' THEN 3 ELSE 1 END THEN CASE v.variant WHEN 'V1' THEN v.delta ELSE v.delta * (s.score / 4e0) END END IGNORE NULLS) OVER w AS size
        FROM tsig s CROSS JOIN (VALUES {variants}) AS v(variant, delta, hold) WINDOW w AS (PARTITION BY v.variant, v.delta, v.hold ORDER BY s.session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "tilts": "SELECT variant, delta, hold, session, CASE WHEN session - fired < hold THEN size ELSE 0e0 END AS tilt FROM tv",
    "legs": f"""SELECT t.variant, t.delta, t.hold, b.session, least(greatest({T.base} + t.tilt, 0e0), 1e0) AS target, b.date,
        coalesce(b.px / lag(b.px) OVER w - 1, 0) AS eq, CASE WHEN b.session = 1 THEN 0e0 ELSE b.bond_ret END AS bd,
        coalesce(date_trunc('month', b.date) <> lead(date_trunc('month', b.date)) OVER w, false) AS rebal
        FROM tilts t JOIN bonds b ON b.session = t.session WINDOW w AS (PARTITION BY t.variant, t.delta, t.hold ORDER BY b.session)""",
    "legs2": "SELECT *, coalesce(target <> lag(target) OVER (PARTITION BY variant, delta, hold ORDER BY session), false) OR (rebal AND session > 1) AS trade FROM legs",
    # the recurrence itself, a session at a time
    "sim": f"""SELECT variant, delta, hold, session, target AS w, 1e0 AS equity, 0e0 AS moved FROM legs2 WHERE session = 1
        UNION ALL
        SELECT l.variant, l.delta, l.hold, l.session,
          CASE WHEN l.trade THEN l.target ELSE s.w * (1 + l.eq) / (1 + s.w * l.eq + (1 - s.w) * l.bd) END,
          s.equity * (1 + s.w * l.eq + (1 - s.w) * l.bd - CASE WHEN l.trade AND abs(l.target - s.w * (1 + l.eq) / (1 + s.w * l.eq + (1 - s.w) * l.bd)) > {T.min_trade} THEN abs(l.target - s.w * (1 + l.eq) / (1 + s.w * l.eq + (1 - s.w) * l.bd)) * {T.cost_bps} / 10000e0 ELSE 0e0 END),
          CASE WHEN l.trade AND abs(l.target - s.w * (1 + l.eq) / (1 + s.w * l.eq + (1 - s.w) * l.bd)) > {T.min_trade} THEN abs(l.target - s.w * (1 + l.eq) / (1 + s.w * l.eq + (1 - s.w) * l.bd)) ELSE 0e0 END
        FROM sim s JOIN legs2 l ON l.variant = s.variant AND l.delta = s.delta AND l.hold = s.hold AND l.session = s.session + 1""",
    "rets": "SELECT *, equity / lag(equity) OVER w - 1 AS r, equity / max(equity) OVER w - 1 AS dd FROM sim WINDOW w AS (PARTITION BY variant, delta, hold ORDER BY session)",
    "met0": "SELECT variant, delta, hold, count(r) / 252e0 AS years, max_by(equity, session) AS final, stddev_samp(r) * sqrt(252) AS vol, min(dd) AS max_dd, sum(moved) AS turnover FROM rets GROUP BY 1, 2, 3",
    "met": "SELECT variant, delta, hold, pow(final, 1 / years) - 1 AS cagr, vol, (pow(final, 1 / years) - 1) / vol AS sharpe, max_dd, years, turnover / years AS turnover_per_year FROM met0",
    "snaps": """SELECT ticker, CAST(month + INTERVAL 1 MONTH AS DATE) AS snapshot_date FROM (
        SELECT date_trunc('month', date) AS month, ticker, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY sum(volume) DESC, ticker) AS k FROM cells GROUP BY 1, 2) WHERE k <= 15""",
    "memb": "SELECT c.session, c.date, s.ticker FROM cal c JOIN snaps s ON s.snapshot_date = (SELECT max(d.snapshot_date) FROM snaps d WHERE d.snapshot_date <= c.date)",
    "mpanel": "SELECT p.* FROM panel p JOIN memb a ON a.session = p.session AND a.ticker = p.ticker",
    "vcells": "SELECT ticker % 5 AS key, date, CAST(sum(px) AS DOUBLE) AS value, sum(volume) AS volume FROM cells GROUP BY 1, 2",
    "hours": "SELECT event_type AS key, CAST(date_diff('hour', TIMESTAMP '2020-01-01 00:00:00', date_trunc('hour', ts)) AS INTEGER) AS session, count(*) AS n FROM events GROUP BY 1, 2",
    "hflags": "SELECT key, session, n > avg(n) OVER (PARTITION BY key ORDER BY session ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS flag FROM hours",
    "starts2": "SELECT key, session FROM (SELECT *, flag AND NOT coalesce(lag(flag) OVER (PARTITION BY key ORDER BY session), false) AS s FROM hflags) WHERE s",
}
#: The same recurrence over eras, each numbered from 1, and over rotations of the tilt.
TABLES["etilts"] = """SELECT CASE WHEN year(b.date) < 1999 THEN 'early' ELSE 'late' END AS variant, t.delta, t.hold, t.session AS orig, t.tilt,
    row_number() OVER (PARTITION BY year(b.date) < 1999 ORDER BY t.session) AS session FROM tilts t JOIN bonds b ON b.session = t.session"""
TABLES["turns"] = """SELECT draw, n, (((x * 48271 + draw * 16807 + 7) % 2147483647) * 48271) % 2147483647 * (n - 1) // 2147483647 + 1 AS k
    FROM (SELECT (CAST(12345 AS BIGINT) * 48271 + 42 * 16807 + 7) % 2147483647 AS x, (SELECT count(*) FROM cal) AS n) CROSS JOIN (SELECT CAST(range AS BIGINT) AS draw FROM range(2000))"""
TABLES["rtilts"] = "SELECT r.draw AS variant, t.delta, t.hold, (t.session - 1 + r.k) % r.n + 1 AS session, (t.session - 1 + r.k) % r.n + 1 AS orig, t.tilt FROM tilts t CROSS JOIN turns r"
#: Rotations are too many for the recurrence: growth between trades by running products instead.
TABLES["snapm"] = "SELECT CAST(date_trunc('month', date) AS DATE) AS m, count(DISTINCT ticker) AS k FROM memb GROUP BY 1"
for x in "er":
    TABLES[f"{x}legs"] = TABLES["legs"].replace("b.session, least", "t.session, least").replace("WHEN b.session = 1", "WHEN t.session = 1").replace("FROM tilts t JOIN bonds b ON b.session = t.session", f"FROM {x}tilts t JOIN bonds b ON b.session = t.orig")
    TABLES[f"{x}legs2"] = TABLES["legs2"].replace("FROM legs", f"FROM {x}legs")
    TABLES[f"{x}sim"] = TABLES["sim"].replace("FROM legs2", f"FROM {x}legs2").replace("FROM sim s JOIN legs2", f"FROM {x}sim s JOIN {x}legs2")
    TABLES[f"{x}rets"] = TABLES["rets"].replace("FROM sim", f"FROM {x}sim")
    TABLES[f"{x}met0"] = TABLES["met0"].replace("FROM rets", f"FROM {x}rets")
    TABLES[f"{x}met"] = TABLES["met"].replace("FROM met0", f"FROM {x}met0")
TABLES["wseg"] = """SELECT *, coalesce(sum(CAST(trade AS INTEGER)) OVER b, 0) AS seg, coalesce(last_value(CASE WHEN trade OR session = 1 THEN target END IGNORE NULLS) OVER b, target) AS w0
    FROM rlegs2 WINDOW b AS (PARTITION BY variant ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
TABLES["wgrow"] = """SELECT *, w0 * exp(sum(ln(1 + eq)) OVER s) AS e, (1 - w0) * exp(sum(ln(1 + bd)) OVER s) AS f FROM wseg WINDOW s AS (PARTITION BY variant, seg ORDER BY session)"""
TABLES["wday"] = f"""SELECT variant, session, CASE WHEN trade AND abs(target - e / (e + f)) > {T.min_trade} THEN abs(target - e / (e + f)) ELSE 0e0 END AS moved, (e + f) / coalesce(lag(e + f) OVER (PARTITION BY variant, seg ORDER BY session), 1e0) AS grown FROM wgrow"""
TABLES["wcurve"] = f"SELECT variant, session, moved, exp(sum(ln(grown - moved * {T.cost_bps} / 10000e0)) OVER (PARTITION BY variant ORDER BY session)) AS equity FROM wday"
TABLES["wrets"] = "SELECT *, equity / lag(equity) OVER w - 1 AS r, equity / max(equity) OVER w - 1 AS dd FROM wcurve WINDOW w AS (PARTITION BY variant ORDER BY session)"
TABLES["wmet0"] = "SELECT variant, count(r) / 252e0 AS years, max_by(equity, session) AS final, stddev_samp(r) * sqrt(252) AS vol FROM wrets GROUP BY 1"
TABLES["wmet"] = "SELECT variant, pow(final, 1 / years) - 1 AS cagr, (pow(final, 1 / years) - 1) / vol AS sharpe FROM wmet0"
TABLES["mwide"] = TABLES["wide"].replace("{panel}", "mpanel")
TABLES["wide"] = TABLES["wide"].replace("{panel}", "panel")
TABLES["mdaily"] = TABLES["daily"].replace("JOIN wide w", "JOIN mwide w")


def sql(final: str, **params) -> str:
    """final with the tables that it needs, in the order in which they are defined."""
    import re

    order = [*[k for k in TABLES if k not in ("mwide", "mdaily")]]
    order[order.index("mpanel") + 1 : order.index("mpanel") + 1] = ["mwide", "mdaily"]
    need, todo = set(), [final]
    while todo:
        for name in re.findall(r"\b(\w+)\b", todo.pop()):
            if name in TABLES and name not in need:
                need.add(name)
                todo.append(TABLES[name])
    fill = {"draws": 50, "block": 21, "variants": "('V1', 2e-1, 21)"} | params
    body = ",\n".join(f"{k} AS {'' if k.endswith(('ema', 'sim')) else 'MATERIALIZED '}({TABLES[k]})" for k in order if k in need)
    out = f"WITH RECURSIVE {body}\n{final}" if need else final
    for k, v in fill.items():
        out = out.replace("{" + k + "}", str(v))
    return out


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)
