"""Exponential means and bootstraps against pandas and loops."""

import numpy as np
import pandas as pd
import pytest

from surgeline.functions import series as S
from surgeline.operators import stress as ST
from surgeline.operators import study as E
from tests.test_registered_jobs import drawn


def test_exponential_means_match_pandas_over_gaps(spark):
    r = np.random.default_rng(4)
    rows = []
    for u in range(4):
        x = r.normal(50, 20, 900)
        x[r.random(900) < (0, 0.05, 0.5, 0.97)[u]] = np.nan
        x[200:420] = np.nan
        x[: u * 3] = np.nan
        rows += [(f"U{u}", i, float(v), float(v * -1e6)) for i, v in enumerate(x)]
    rows += [("none", i, None, float("nan")) for i in range(5)] + [("one", 3, 7.0, None)]
    df = spark.createDataFrame(rows, "universe string, session int, v double, z double")
    spans = {"s1": ("v", 1), "s2": ("v", 2), "s10": ("v", 10), "s39": ("v", 39), "z19": ("z", 19)}
    got = S.ema(df.repartition(5), ["universe"], spans).toPandas().sort_values(["universe", "session"])
    assert list(got.columns) == ["universe", "session", "v", "z", *spans]
    for _, part in got.groupby("universe"):
        for name, (column, span) in spans.items():
            want = part[column].astype(float).ewm(span=span, adjust=False).mean()
            assert np.allclose(part[name].astype(float), want, rtol=1e-12, atol=0, equal_nan=True), (name, span)


@pytest.mark.parametrize("n", [1, 15, 21, 22, 130])
def test_bootstraps_of_short_and_long_series_match_loops(spark, n):
    r = np.random.default_rng(n)
    x, y = r.normal(0, 1, n), r.normal(0, 1, n)
    starts = lambda k, *keys: [drawn(max(n - 21, 1), 42, *keys, k, b) for b in range(max(n // 21, 1))]
    fwd = spark.createDataFrame([("U", i, "1w", 5, float(v)) for i, v in enumerate(x)] + [("U", n, "1w", 5, None)], "universe string, session int, horizon string, h int, fwd double")
    got = {g.draw: g for g in E.bootstrap(fwd, 70, 21).collect()}
    assert len(got) == 70
    for k in range(70):
        v = np.concatenate([x[s : s + 21] for s in starts(k, 5)])
        assert abs(got[k].win - (v > 0).mean()) < 1e-12 and abs(got[k].med - np.median(v)) < 1e-12
    rows = spark.createDataFrame([("U", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "key string, i int, x double, y double")
    slopes = []
    for k in range(70):
        at = np.concatenate([np.arange(s, min(s + 21, n)) for s in starts(k)])
        if n > 1:
            slopes.append(np.cov(x[at], y[at], bias=True)[0, 1] / x[at].std())
    out = ST.bootstrap_slopes(rows, 70, 21).first()
    if n > 1:
        assert np.allclose([out.slope_lo5, out.slope_med, out.slope_hi95], np.quantile(slopes, [0.05, 0.5, 0.95]), atol=1e-10)
    else:
        assert out.slope_med is None
