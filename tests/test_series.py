import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surgeline.functions import series as S
from surgeline.operators import breadth as B
from surgeline.params import ThrustParams
from surgeline.sources import panel as D
from surgeline.sources import store


@pytest.fixture(scope="module")
def random_panel():
    """Prices with gaps: a ticker may miss sessions, so windows start anew."""
    rng = np.random.default_rng(1)
    px = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0, 0.01, (140, 9)), axis=0))).round(2)
    px = px.where(rng.random(px.shape) > 0.02)
    px.index += 1
    vol = pd.DataFrame(rng.integers(1000, 9999, px.shape), index=px.index).where(px.notna())
    return px, vol


def long(spark, px, vol):
    rows = [("U", int(s), int(t), float(px.loc[s, t]), int(vol.loc[s, t])) for s in px.index for t in px.columns if px.loc[s, t] == px.loc[s, t]]
    return spark.createDataFrame(rows, "universe string, session int, ticker int, px double, volume long")


def calendar(spark, n):
    return spark.range(1, n + 1).select(F.lit("U").alias("universe"), F.col("id").cast("int").alias("session"), F.expr("date_add(date'2015-01-01', cast(id as int))").alias("date"))


def test_breadth_matches_wide_frames(spark, random_panel):
    px, vol = random_panel
    p = ThrustParams(ma_window=7, high_low_window=20)
    got = B.breadth(long(spark, px, vol), calendar(spark, len(px)), p).toPandas().set_index("session").sort_index()
    prev, ma = px.shift(1), px.rolling(7, min_periods=7).mean()
    hi, lo = px.rolling(20, min_periods=20).max(), px.rolling(20, min_periods=20).min()
    valid = px.notna() & prev.notna()
    want = {
        "advances": (px > prev).sum(axis=1), "declines": (px < prev).sum(axis=1), "valid_count": valid.sum(axis=1), "ma_valid_count": (px.notna() & ma.notna()).sum(axis=1),
        "new_highs": (px >= hi).sum(axis=1), "new_lows": (px <= lo).sum(axis=1), "hl_valid_count": hi.notna().sum(axis=1), "up_volume": vol.where(px > prev, 0).sum(axis=1), "total_volume": vol.where(valid, 0).sum(axis=1),
    }
    for name, x in want.items():
        assert (got[name].to_numpy() == x.to_numpy()).all(), name
    assert (got["above_count"].to_numpy() - (px > ma).sum(axis=1).to_numpy() == 0).mean() > 0.99


def test_ema_over_gaps_is_pandas(spark):
    rng = np.random.default_rng(2)
    x = pd.Series(rng.normal(size=60)).where(rng.random(60) > 0.3)
    df = spark.createDataFrame([("U", i, None if v != v else float(v)) for i, v in enumerate(x)], "universe string, session int, v double")
    got = S.ema(df, ["universe"], {"e": ("v", 10)}).toPandas().sort_values("session").e
    want = x.ewm(span=10, adjust=False).mean()
    assert np.allclose(got.astype(float), want, equal_nan=True)


def test_windows(spark):
    flags = [False, True, True, False, True, False, False, True, True, True]
    df = spark.createDataFrame([("U", i, f, i) for i, f in enumerate(flags)], "universe string, session int, f boolean, v int")
    w = S.by("universe")
    got = df.select("session", S.edges(F.col("f"), w).alias("e"), S.any_within(F.col("f"), w, 2).alias("a"), S.rolling_sum(F.col("v"), w, 3).alias("s")).toPandas().sort_values("session")
    assert got.session[got.e].tolist() == [1, 4, 7]
    assert got.a.tolist() == pd.Series(flags).rolling(2, min_periods=1).max().astype(bool).tolist()
    assert got.s.fillna(-1).tolist() == pd.Series(range(10)).rolling(3).sum().fillna(-1).tolist()


def test_deemer_waits_for_ten_sessions(spark):
    df = calendar(spark, 30).select("*", F.lit(300).alias("advances"), F.lit(150).alias("declines"), *[F.lit(0).alias(c) for c in B.COUNTS[2:]], F.lit(None).cast("double").alias("pct_above"), F.lit(None).cast("double").alias("up_volume_ratio"))
    got = B.detectors(B.lines(df)).toPandas().sort_values("session").deemer.tolist()
    assert got == [False] * 9 + [True] * 21


def test_surge_fires_and_events_count_dimensions(spark):
    panel = D.synthetic(spark, 700, 60)
    sessions = panel.select("universe", "session", "date").distinct()
    out = B.thrust(panel, sessions, ThrustParams(min_valid=50)).toPandas().sort_values("session")
    assert out.d2.any() and out.event.any()
    on = out[["d1_on", "d2_on", "d3_on", "d4_on"]].sum(axis=1)
    assert (on == out.n_dimensions).all() and (out.event == (out.n_dimensions > out.n_dimensions.shift(1, fill_value=0))).all()
    assert not out.data_ok.iloc[:251].any()


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"snapshots": {"2020-01-02": {"tickers": ["A", "B"]}, "2020-01-05": {"tickers": ["B"]}}}')
    snaps = D.read_snapshots(spark, str(tmp_path / "s.json"))
    days = spark.createDataFrame([("ALL", i, f"2020-01-0{i}") for i in range(1, 8)], "universe string, session int, d string").select("universe", "session", F.to_date("d").alias("date"))
    got = D.as_of(days, snaps).groupBy("session").agg(F.sort_array(F.collect_list("ticker")).alias("t")).collect()
    assert {r.session: r.t for r in got} == {2: ["A", "B"], 3: ["A", "B"], 4: ["A", "B"], 5: ["B"], 6: ["B"], 7: ["B"]}
    (tmp_path / "c.json").write_text('{"tickers": {"A": {"dates": ["2020-01-01", "2020-01-02"], "adjClose": [1.23456, null], "volume": [null, 5]}}, "last_updated": "x"}')
    assert [(r.ticker, r.close, r.volume) for r in D.read_cache(spark, str(tmp_path / "c.json")).collect()] == [("A", 1.2346, 0)]
    rows = spark.createDataFrame([("TOTALRETURN", "%X", "2020-01-01", 1.0, 10), ("NONE", "%X", "2020-01-01", 2.0, 20), ("TOTALRETURN", "Y", "2020-01-01", 3.0, 30)], "basis string, symbol string, date string, close double, volume long")
    store.write_series(rows, str(tmp_path / "store"), "stamp-1")
    store.write_series(rows, str(tmp_path / "store"), "stamp-2")
    back = store.read_series(spark, str(tmp_path / "store"), "NONE")
    assert [(r.symbol, r.volume, r.source_stamp) for r in back.collect()] == [("%X", 20, "stamp-2")]
    assert [(r.symbol, r.close, r.volume) for r in D.total_return_panel(spark.read.parquet(str(tmp_path / "store"))).collect()] == [("%X", 1.0, 20)]
