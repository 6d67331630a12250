"""Matching, thinning and stretches of keys with very many events, against loops."""

import bisect

import numpy as np
import pytest

from surgeline.functions import chains as CH
from surgeline.operators import compare as C
from surgeline.operators import stress as ST
from surgeline.operators import study as E


def greedy(a, b, reach):
    """(a, b) of each event, by a loop over sorted lists."""
    free, out = sorted(b), []
    for x in sorted(a):
        lo, hi = bisect.bisect_left(free, x - reach), bisect.bisect_right(free, x + reach)
        near = min(free[lo:hi], key=lambda y: (abs(y - x), y), default=None)
        if near is not None:
            free.remove(near)
        out.append((x, near))
    return out + [(None, y) for y in free]


def thinned(places, gap):
    out = []
    for x in sorted(places):
        if not out or x - out[-1] > gap:
            out.append(x)
    return out


def frame(spark, key, places):
    return spark.createDataFrame([(key, int(x)) for x in places], "key string, session int")


@pytest.mark.parametrize("dense", [3, 60])
def test_200000_events_of_a_key_match_as_in_a_loop(spark, dense):
    r = np.random.default_rng(dense)
    a, b = (np.unique(r.integers(-1000, 100_000 * dense, 100_000)) for _ in range(2))
    few = {"x": [1, 2, 3, 50], "y": []}, {"x": [2, 4, 55], "y": [7]}
    da, db = (frame(spark, "k", v).union(frame(spark, "x", f["x"] * 2)).union(frame(spark, "y", f["y"])) for v, f in zip((a, b), few))
    got = {}
    for row in C.match_events(da, db).collect():
        got.setdefault(row.key, []).append((row.a, row.b))
    order = lambda p: sorted(p, key=lambda x: (x[0] is None, x[0] or 0, x[1] or 0))
    assert order(got["k"]) == order(greedy(a.tolist(), b.tolist(), 5))
    assert all(order(got[k]) == order(greedy(few[0][k], few[1][k], 5)) for k in ("x", "y"))


@pytest.mark.parametrize("dense", [2, 12])
def test_a_key_with_very_many_events_is_thinned_as_in_a_loop(spark, dense):
    r = np.random.default_rng(1)
    places = np.unique(r.integers(-5000, 100_000 * dense, 100_000))
    rows = frame(spark, "k", places).union(frame(spark, "z", [5, 5, 26, 27])).withColumnRenamed("session", "i")
    got = ST.declustered(rows, ["key"], 21).toPandas().groupby("key").i.apply(sorted).to_dict()
    assert got == {"k": thinned(places.tolist(), 21), "z": [5, 27]}
    assert ST.declustered(rows.where("false"), ["key"], 21).count() == 0


def test_stretches_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(CH, "WIDTH", 8)
    r = np.random.default_rng(2)
    for gap in (1, 2, 7):
        places = np.unique(r.integers(-100, 300, 150))
        want, start = {}, None
        for before, x in zip([None, *places], places):
            start = x if before is None or x - before > gap else start
            want[int(x)] = int(start)
        got = {x.i: x.island for x in CH.islands(frame(spark, "k", places).withColumnRenamed("session", "i"), ["key"], "i", gap).collect()}
        assert got == want


def test_worst_falls_of_any_length(spark):
    px = 100 * np.exp(np.cumsum(np.random.default_rng(5).normal(0, 0.02, 140)))
    bench = spark.createDataFrame([("U", i, float(v)) for i, v in enumerate(px)] + [("V", 0, 5.0)], "universe string, session int, px double")
    lengths = [1, 2, 3, 7, 64, 100, 127, 140, 141]
    got = {r.session: r for r in E.worst_falls(bench, lengths).where("universe = 'U'").collect()}
    for i in range(140):
        for n in lengths:
            w = px[i : i + n]
            want = (w / np.maximum.accumulate(w) - 1).min() if len(w) == n else None
            assert (got[i][f"mdd_{n}"] is None) == (want is None) and (want is None or abs(got[i][f"mdd_{n}"] - want) < 1e-12)
