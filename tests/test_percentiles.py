import numpy as np
import pytest

from surgeline.functions import percentiles as P

POINTS = {"a": ("x", 0.0), "b": ("x", 0.25), "c": ("x", 0.5), "d": ("x", 0.95), "e": ("x", 1.0), "f": ("y", 0.3)}


@pytest.mark.parametrize("few, buckets", [(1, 2), (50, 16), (100_000, 4096)])
def test_narrowing_gives_what_percentile_gives(spark, monkeypatch, few, buckets):
    monkeypatch.setattr(P, "FEW", few)
    monkeypatch.setattr(P, "BUCKETS", buckets)
    r = np.random.default_rng(few)
    n = 300 if few == 1 else 20_000
    groups = {
        "normal": r.normal(size=n), "ties": r.integers(0, 3, n).astype(float), "same": np.full(50, 7.5), "one": np.array([3.25]), "two": np.array([1.0, 2.0]),
        "far": np.r_[r.normal(0, 1e-9, n // 2), -1.7e308, 1.7e308, 1e30], "exp": np.exp(r.normal(0, 5, n)),
    }
    rows = [(k, float(x), float(-x * 3)) for k, v in groups.items() for x in v] + [("normal", None, None), ("none", None, None), (None, 1.0, 2.0)]
    rows = [(k, x, y if y is None or abs(y) < 1e308 else 0.0) for k, x, y in rows]
    df = spark.createDataFrame(rows, "key string, x double, y double")
    got = {g.key: g for g in P.narrowed(df.where("key is not null"), ["key"], POINTS).collect()}
    want = {w.key: w for w in P.percentiles(df.where("key is not null"), ["key"], POINTS).collect()}
    assert got.keys() == want.keys() and got["none"].c is None
    for k in groups:
        for name in POINTS:
            assert got[k][name] == pytest.approx(want[k][name], rel=1e-12, abs=0), (k, name)


def test_a_bound_decides_for_all(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id % 3 as key", "id * 1.5d as x", "id * 2.0d as y")
    want = sorted(map(tuple, P.percentiles(df, ["key"], POINTS).collect()))
    monkeypatch.setattr(P, "MOST", 100)
    called = []
    real = P.narrowed
    monkeypatch.setattr(P, "narrowed", lambda *a: (called.append(1), real(*a))[1])
    assert sorted(map(tuple, P.percentiles(df, ["key"], POINTS).collect())) == want and called
    assert P.percentiles(df.where("false"), ["key"], POINTS).count() == 0
