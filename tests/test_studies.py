import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surgeline.operators import compare as C
from surgeline.operators import guards as G
from surgeline.operators import portfolio as PF
from surgeline.operators import stress as ST
from surgeline.operators import study as E
from surgeline.params import TiltParams


def bench(spark, values):
    return spark.createDataFrame([("U", i, float(v)) for i, v in enumerate(values)], "universe string, session int, px double")


def test_forward_returns_align(spark):
    got = E.forward(bench(spark, range(1, 101)), {"1w": 5}).toPandas().sort_values("session").fwd
    assert got.iloc[0] == 5.0 and got.iloc[-5:].isna().all() and got.iloc[:-5].notna().all()


def test_no_look_ahead(spark):
    px = range(100, 160)
    comp = spark.createDataFrame([("U", i, 2 if i == 30 else 0, i == 30) for i in range(60)], "universe string, session int, n_dimensions int, event boolean")
    b = bench(spark, px)
    got = E.conditional(E.lagged(comp, b), E.forward(b, {"1w": 5}), b, (1, 3)).toPandas().set_index("threshold")
    assert got.n[1] == 1 and got.n[3] == 0 and abs(got.median_ret[1] - (136 / 131 - 1)) < 1e-12 and np.isnan(got.median_ret[3])


def test_drawdown_matches_a_loop(spark):
    x = 100 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.02, 80)))
    b = bench(spark, x)
    got = E.drawdowns(E.forward(b, {"a": 12}), b, {"a": 12}).toPandas().set_index("session").mdd
    for i in range(80):
        if i + 12 < 80:
            w = x[i : i + 13]
            assert abs(got[i] - (w / np.maximum.accumulate(w) - 1).min()) < 1e-12
        else:
            assert i not in got.index


def test_clusters_and_greedy(spark):
    d = spark.createDataFrame([("k", x) for x in ("2020-01-01", "2020-02-01", "2020-06-01", "2020-06-02")], "key string, d string").select("key", F.to_date("d").alias("date"))
    assert E.clusters(d, ["key"], 63).first().clusters == 2
    rows = spark.createDataFrame([("k", i) for i in (1, 5, 23, 30, 45, 60)], "key string, i int")
    assert sorted(r.i for r in ST.declustered(rows, ["key"], 21).collect()) == [1, 23, 45]


@pytest.fixture(scope="module")
def market():
    rng = np.random.default_rng(5)
    n = 400
    date = pd.bdate_range("2001-01-01", periods=n)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    bond = rng.normal(0, 0.002, n)
    event, score = rng.random(n) < 0.03, rng.integers(0, 5, n)
    return date, px, bond, event, score


def rows_of(spark, m):
    date, px, bond, event, score = m
    return spark.createDataFrame([("U", i + 1, date[i].date(), float(px[i]), float(bond[i]), bool(event[i]), int(score[i])) for i in range(len(px))], "universe string, session int, date date, px double, bond_ret double, event boolean, score int")


@pytest.mark.parametrize("variant", ["V1", "V2"])
def test_tilt_and_backtest_match_the_loop(spark, market, variant):
    date, px, bond, event, score = market
    p = TiltParams()
    tilted = PF.tilt(rows_of(spark, market), variant, 0.2, 15, ["universe"])
    got = PF.backtest(tilted, ["universe"], p).toPandas().sort_values("session")
    left, now, want = 0, 0.0, []
    for e, s in zip(event, score):
        if e and s >= (3 if variant == "V1" else 1):
            left, now = 15, 0.2 if variant == "V1" else 0.2 * min(s, 4) / 4
        want.append(now if left > 0 else 0.0)
        left -= 1
    assert np.allclose(got.tilt, want)
    target = np.clip(p.base + np.array(want), 0, 1)
    month = date.to_period("M")
    w, equity, moved = target[0], [1.0], [0.0]
    for t in range(1, len(px)):
        r = px[t] / px[t - 1] - 1
        port = w * r + (1 - w) * bond[t]
        w = w * (1 + r) / (1 + port)
        cost = 0.0
        if (t + 1 < len(px) and month[t] != month[t + 1]) or target[t] != target[t - 1]:
            cost = abs(target[t] - w) if abs(target[t] - w) > p.min_trade else 0.0
            w = target[t]
        moved.append(cost)
        equity.append(equity[-1] * (1 + port - cost * p.cost_bps / 10000))
    assert np.allclose(got.equity, equity, rtol=1e-10) and np.allclose(got.moved, moved, atol=1e-12)
    m = PF.metrics(PF.backtest(tilted, ["universe"], p), ["universe"], p).first()
    e = pd.Series(equity)
    assert abs(m.vol - e.pct_change().dropna().std() * np.sqrt(252)) < 1e-9 and abs(m.max_dd - (e / e.cummax() - 1).min()) < 1e-9


def test_rotation_moves_every_tilt(spark, market):
    rows = PF.tilt(rows_of(spark, market), "V1", 0.2, 15, ["universe"]).select("session", "date", "px", "bond_ret", "tilt")
    got = PF.rotations(rows, 3).toPandas()
    base = rows.toPandas().sort_values("session").tilt.to_numpy()
    for _, x in got.groupby("draw"):
        x = x.sort_values("session").tilt.to_numpy()
        assert any(np.allclose(np.roll(base, k), x) for k in range(1, len(base)))


def test_event_matching(spark):
    a = spark.createDataFrame([("k", i) for i in (10, 25, 48)], "key string, session int")
    b = spark.createDataFrame([("k", 12)], "key string, session int")
    assert {(r.a, r.b) for r in C.match_events(a, b).collect()} == {(10, 12), (25, None), (48, None)}
    ends = spark.createDataFrame([("k", 49)], "key string, last int")
    got = {(r.side, r.session, r.pending) for r in C.one_sided(a, b, ends).collect()}
    assert got == {("self", 25, False), ("self", 48, True)}
    # what is left of b may be excused by an event that is taken already
    c = spark.createDataFrame([("k", 12), ("k", 13)], "key string, session int")
    assert all(r.side == "self" for r in C.one_sided(a, c, ends).collect())


def test_edge_needs_enough_overlap(spark):
    df = spark.createDataFrame([("U", i, True, False, False, True, 2) for i in range(15)], "universe string, i int, d1_on boolean, d2_on boolean, d3_on boolean, d4_on boolean, n_dimensions int").withColumn("date", F.expr("date_add(date'2026-07-21', i)"))
    other = df.withColumn("d2_on", F.col("i") == 13)
    assert [(r.field, r.deployed, r.candidate) for r in C.edge_compare(df, other).collect()] == [("d2_on", 0, 1)]
    few = C.edge_summary(df, other.where("i > 11")).first()
    assert few.insufficient_overlap and few.mismatches == 0


def test_guards(spark):
    s = spark.createDataFrame([(x,) for x in ("C", "C-199811", "AAL-199702", "BRK-B", "BF-B")], "symbol string")
    assert [r.b for r in s.select(G.base_ticker(F.col("symbol")).alias("b")).collect()] == ["C", "C", "AAL", "BRK-B", "BF-B"]
    assert [(r.base, r.uses) for r in G.collisions(s).collect()] == [("C", 2)]
    with pytest.raises(Exception, match="duplicate symbol"):
        G.collisions(s.union(s.limit(1))).collect()
    ages = spark.createDataFrame([("2026-01-31T23:00:00+08:00", "2026-02-01 16:00:00"), ("2026-12-30T08:00:00+08:00", "2027-01-03 02:00:00"), ("2026-01-31T23:00:00", "2026-02-01 16:00:00"), ("2026-02-05T00:00:00Z", "2026-02-01 16:00:00")], "stamp string, now string")
    assert [r.a for r in ages.select(G.age_days(F.col("stamp"), F.to_timestamp("now")).alias("a")).collect()] == [1, 4, 1, 0]
    assert [r.s for r in spark.createDataFrame([("a/b:c*",)], "x string").select(G.safe_name(F.col("x")).alias("s")).collect()] == ["a_b_c_"]
    probe = spark.createDataFrame([(1, True, 1, "1950-01-03", 21104), (2, True, 9, "1992-01-01", 10), (3, None, 1, None, None)], "probe int, ready boolean, age_days int, f string, delisted int").withColumn("first_date", F.to_date("f"))
    assert [len(r.failures) for r in G.depth_failures(probe).orderBy("probe").collect()] == [0, 3, 1]
