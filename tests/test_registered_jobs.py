"""Registered queries do the whole job, on small fixtures and without SQL."""

import datetime as dt

import numpy as np

from surgeline.operators import portfolio as PF
from surgeline.operators import study as E
from surgeline.params import HORIZONS
from surgeline.plans import queries as Q

M = 2147483647


def drawn(n, *keys):
    x = 12345
    for k in keys:
        x = (x * 48271 + k * 16807 + 7) % M
    return x * 48271 % M * n // M


def test_bootstraps_take_2000_draws(spark, monkeypatch):
    px = 100 * np.exp(np.cumsum(np.random.default_rng(1).normal(0, 0.02, 90)))
    bench = spark.createDataFrame([("U", i, float(v)) for i, v in enumerate(px)], "universe string, session int, px double")
    monkeypatch.setattr(Q, "_study", lambda *a: (None, bench, None, E.forward(bench, {"1w": 5})))
    got = Q.block_bootstrap_baseline(spark, "").first()
    fwd = px[5:] / px[:-5] - 1
    n = len(fwd)
    draws = [np.concatenate([fwd[s : s + 21] for b in range(n // 21) for s in [drawn(n - 21, 42, 5, k, b)]]) for k in range(2000)]
    for name, values in (("win", [(x > 0).mean() for x in draws]), ("ret", [np.median(x) for x in draws])):
        assert np.allclose([got[f"base_{name}_lo"], got[f"base_{name}_hi"]], np.quantile(values, [0.05, 0.95]), atol=1e-6)


def test_null_takes_2000_rotations(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, float(100 + r.normal()), float(r.normal(0, 0.001)), 0.2 if 20 <= i < 30 else 0.0) for i in range(1, 81)], "session int, px double, bond_ret double, tilt double").selectExpr("*", "date_add(date'2020-01-01', session) as date")
    monkeypatch.setattr(Q, "_tilts", lambda *a: rows)
    want = PF.null_points(PF.metrics(PF.backtest(PF.rotations(rows, 2000), ["draw"]), ["draw"])).first()
    got = Q.rotation_null(spark, "").first()
    assert all(abs(got[c] - want[c]) < 1e-6 for c in got.asDict())


def test_last_signal_may_be_late(spark, monkeypatch):
    rows = spark.range(2390, 2460).selectExpr("'U' as universe", "cast(id as int) as session", "date_add(date'2020-01-01', cast(id as int)) as date", "id * 1.0d as px", "1 as n_dimensions", "id in (2395, 2450) as event")
    monkeypatch.setattr(Q, "_comp", lambda *a: rows.drop("px"))
    monkeypatch.setattr(Q, "_bench", lambda *a: rows.select("universe", "session", "date", "px"))
    got = Q.last_signal(spark, "").first()
    assert got.anchor == 2451 and got.ret_1w == round(2456 / 2451 - 1, 6) and got.ret_1m is None


def test_drawdowns_of_every_horizon(spark, monkeypatch):
    px = 100 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.02, max(HORIZONS.values()) + 3)))
    bench = spark.createDataFrame([("U", i, float(v)) for i, v in enumerate(px)], "universe string, session int, px double")
    monkeypatch.setattr(Q, "_study", lambda s, d, horizons=HORIZONS: (None, bench, None, E.forward(bench, horizons)))
    got = {r.horizon: r.mdd for r in Q.forward_max_drawdown(spark, "").where("session = 1").collect()}
    assert set(got) == set(HORIZONS)
    for k, h in HORIZONS.items():
        w = px[1 : h + 2]
        assert abs(got[k] - (w / np.maximum.accumulate(w) - 1).min()) < 1e-6


def test_a_query_keeps_nothing_of_the_one_before(spark):
    import __spark_entry__ as entry

    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    d = "/root/testdata/sf0.001"
    spark.catalog.clearCache()
    entry.queries()["conditional_table"](spark, d).count()
    first = held()
    entry.queries()["last_signal"](spark, d).count()
    entry.queries()["conditional_table"](spark, d).count()
    assert 0 < held() <= first
    entry.queries()["panel_cells"](spark, d).count()
    assert held() == 0


def test_zweig_lines_are_compared_on_every_day(spark, monkeypatch):
    """Two sources that differ on days 5 and 70 of 80, long before the last ten, and on day 75, among them."""
    from surgeline.plans import more

    rows = lambda odd: spark.createDataFrame([("U", i, 100 + (60 if i in odd else 0), 100) for i in range(1, 81)], "universe string, session int, advances long, declines long").selectExpr("*", "date_add(date'2020-01-01', session) as date")
    monkeypatch.setattr(more, "_vendor", lambda *a: (rows(()), rows((5, 70, 75))))
    own, other = (1 / 2,) * 80, [160 / 260 if i in (5, 70, 75) else 1 / 2 for i in range(1, 81)]
    z, want = other[0], {}
    for i in range(1, 80):
        z += 2 / 11 * (other[i] - z)
        if abs(z - own[i]) > 0.02:
            want[i + 1] = (round(abs(z - own[i]), 6), i + 1 > 70)
    got = {(r.date - dt.date(2020, 1, 1)).days: (r["diff"], r.recent) for r in more.zweig_tolerance(spark, "").collect()}
    assert got == want and 5 in want and not want[70][1] and want[75][1]


def test_a_pull_of_every_series_reads_the_archive_once_for_each_basis(spark, tmp_path, monkeypatch):
    """Tables of two sizes, with nulls in every column: batches together read a row for each basis and row of the archive, however many suppliers there are, and give what the SQL does."""
    import duckdb
    import pyarrow as pa
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    plain, whole, kept = ds.dataset, Q.pull_batches, []
    monkeypatch.setattr(Q, "pull_batches", lambda asked, source: kept.append((asked, source)) or whole(asked, source))
    for n in (50, 400):
        rows = [(None if k == 1 else 7 * k, None if j == 2 and k % 5 == 0 else dt.datetime(2020, 1, 1 + j), None if k == 3 else float(j + k)) for k in range(n) for j in (0, 1, 1, 2)]
        d = tmp_path / str(n)
        d.mkdir()
        kinds = {"l_suppkey": pa.int64(), "l_shipdate": pa.timestamp("us"), "l_quantity": pa.float64()}
        pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds)), d / "lineitem.parquet")
        got = sorted((tuple(r) for r in Q.series_pull(spark, str(d)).collect()), key=repr)
        c = duckdb.connect()
        c.execute(f"create view lineitem as select * from '{d}/lineitem.parquet'")
        assert got == sorted(c.execute(f"select symbol, basis, date, close, volume, failure from ({Q.ORACLE_SQL['series_pull']})").fetchall(), key=repr)
        asked, source = kept.pop()
        read = []
        monkeypatch.setattr(ds, "dataset", lambda *a, **k: read.append(plain(*a, **k).count_rows()) or plain(*a, **k))
        for r in asked.collect():
            list(source(r.symbols, r.basis))
        monkeypatch.setattr(ds, "dataset", plain)
        assert sum(read) == 2 * 3 * n
