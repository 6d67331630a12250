import datetime as dt
import json
import math

import pytest

from surgeline.operators import compare as C
from surgeline.operators import guards as G
from surgeline.operators import replication as RP
from surgeline.operators import report as RE
from surgeline.sources import store

ROWS = "basis string, symbol string, date string, close double, volume long"


def test_one_basis_is_replaced_without_the_other(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_series(spark.createDataFrame([("NONE", "A", "2020-01-01", 1.0, 1), ("TOTALRETURN", "A", "2020-01-01", 2.0, 1)], ROWS), path, "s1")
    store.write_series(spark.createDataFrame([("NONE", "B", "2020-01-02", 3.0, 1)], ROWS), path, "s2")
    assert [(r.symbol, r.source_stamp) for r in store.read_series(spark, path, "NONE").collect()] == [("B", "s2")]
    assert [(r.symbol, r.source_stamp) for r in store.read_series(spark, path, "TOTALRETURN").collect()] == [("A", "s1")]
    with pytest.raises(ValueError, match="CAPITAL"):
        store.read_series(spark, path, "CAPITAL")
    assert [(str(r.date), r.close) for r in store.series_of(store.read_series(spark, path), "B").collect()] == [("2020-01-02", 3.0)]


def test_refresh_lists_failures(spark, tmp_path):
    def fetch(symbol, basis):
        if symbol == "X":
            raise OSError("no answer")
        return [] if symbol == "E" else [(dt.date(2020, 1, 1), 1.0, 2)]

    out = store.refresh(spark, str(tmp_path / "s"), ["A", "X", "E"], ["NONE", "TOTALRETURN"], fetch, "now")
    assert out["pulled"] == 2 and sorted(out["failed"]) == sorted([("X", b, "no answer") for b in ("NONE", "TOTALRETURN")] + [("E", b, "empty") for b in ("NONE", "TOTALRETURN")])
    assert store.read_series(spark, str(tmp_path / "s"), "NONE").count() == 1
    assert store.refresh(spark, str(tmp_path / "none"), ["X"], ["NONE"], fetch, "now")["pulled"] == 0


def test_cache_round_trip(spark, tmp_path):
    path = str(tmp_path / "cache.json")
    assert store.load_cache(spark, path).count() == 0
    rows = spark.createDataFrame([("A", "2020-01-02", 1.25, 5), ("A", "2020-01-01", 1.0, 0), ("B", "2020-01-01", 2.0, 7)], "ticker string, date string, close double, volume long").selectExpr("ticker", "to_date(date) as date", "close", "volume")
    store.save_cache(rows, path, "stamp")
    back = spark.read.schema("tickers map<string, struct<dates: array<string>, adjClose: array<double>, volume: array<long>>>, last_updated string").json(path)
    assert {r.last_updated for r in back.collect()} == {"stamp"}
    assert sorted(map(tuple, store.load_cache(spark, path).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_documents_merge_and_render(spark, tmp_path):
    path = "file://" + str(tmp_path / "r" / "doc.json")
    assert store.read_document(spark, path) == {}
    store.merge_document(spark, path, "a", {"x": float("nan"), "y": [1, math.nan]})
    store.merge_document(spark, path, "b", {"d": dt.date(2020, 1, 1)})
    store.merge_document(spark, path, "a", {"x": 2})
    assert store.read_document(spark, path) == {"a": {"x": 2}, "b": {"d": "2020-01-01"}}
    page = store.render("<script>__DATA__</script><b>__DATA__</b>", {"x": math.nan})
    assert page == '<script>{"x":null}</script><b>__DATA__</b>'


def test_document_of_a_run(spark):
    names = "session int, date string, n_dimensions int, score double, valid_count int, data_ok boolean, event boolean"
    flags = [f"d{k}_on" for k in (1, 2, 3, 4)] + ["zweig", "deemer", "mcclellan", "d2", "nhnl_ratio", "nhnl_net", "d4"]
    rows = [(i, f"2020-01-{i:02d}", i % 3, 1.0, 9, 3 <= i <= 20, i in (5, 12)) for i in range(1, 25)]
    comp = spark.createDataFrame(rows, names).selectExpr("'U' as universe", "session", "to_date(date) as date", *[x.split()[0] for x in names.split(", ")[2:]], *[f"session % 2 = 0 as {f}" for f in flags], *[f"session / 10.0d as {c}" for c in ("zweig_line", "deemer_ratio", "mcc", "pct_above", "high_ratio", "up_volume_ratio")], "session as net_highs")
    bench = comp.selectExpr("universe", "session", "date", "100.0d + session as px")
    study = spark.createDataFrame([("U", 1, "1w", 3)], "universe string, threshold int, horizon string, n int")
    from surgeline.params import RELAXED

    doc = json.loads(RE.documents(comp, bench, study, RELAXED, False).toJSON().first())
    assert doc["current"]["as_of"] == "2020-01-24" and len(doc["formation"]) == 7 and doc["study"] == [{"threshold": 1, "horizon": "1w", "n": 3}]
    assert doc["timeline"]["date"][0] == "2020-01-03" and len(doc["timeline"]["px"]) == 18
    assert doc["last_signal"]["event_date"] == "2020-01-05"  # session 12 has no dimension on
    path = sorted((r.day, r.ret) for r in RE.signal_path(comp, bench).collect())
    assert path[0] == (0, 0.0) and abs(path[-1][1] - (124 / 106 - 1)) < 1e-12 and len(path) == 19
    assert RE.signal_path(comp.where("session < 5"), bench).count() == 0


def test_refusals(spark):
    panel = spark.createDataFrame([("U", f"s{i}") for i in range(19)], "universe string, symbol string")
    expected = spark.createDataFrame([("U", f"s{i}") for i in range(20)], "universe string, symbol string")
    assert G.refuse_incomplete(panel, expected).count() == 19
    with pytest.raises(Exception, match="incomplete panel: U"):
        G.refuse_incomplete(panel.limit(17), expected).collect()
    good = [(b, "A", d, 1.0, 1) for b in ("NONE", "TOTALRETURN") for d in ("2020-01-01", "2020-01-02")]
    assert G.refuse_gaps(spark.createDataFrame(good, ROWS), "NONE", "TOTALRETURN").count() == 4
    with pytest.raises(Exception, match="dates of the bases differ: A"):
        G.refuse_gaps(spark.createDataFrame(good[:3], ROWS), "NONE", "TOTALRETURN").collect()


def test_readiness_and_sync(spark):
    stores = spark.createDataFrame([(1, False, ["a"], 1), (2, True, ["a"], 1), (3, True, ["a", "b"], 0), (4, True, ["a", "b"], 5), (5, None, None, None)], "store int, running boolean, databases array<string>, delisted int")
    assert {r.store: r.reason for r in G.readiness(stores, ["a", "b"]).collect()} == {1: "service is down", 2: "missing database: b", 3: "no delisted members", 4: "ok", 5: "service is down"}
    kind = "roster string, snapshot_date string, n_tickers int"
    current = spark.createDataFrame([(r, d, 5) for r in ("longer", "same", "bad", "gone") for d in ("2020-01-01", "2020-02-01")], kind)
    source = spark.createDataFrame([("longer", d, 5) for d in ("2020-01-01", "2020-02-01", "2020-03-01")] + [("same", d, 5) for d in ("2020-01-01", "2020-02-01")] + [("bad", "2020-03-01", 0), ("bad", "2020-02-01", 1)], kind)
    assert {r.roster: (r.outcome, r.in_force) for r in G.sync(source, current).collect()} == {"longer": ("synced", "2020-03-01"), "same": ("current", "2020-02-01"), "bad": ("rejected", "2020-02-01"), "gone": ("rejected", "2020-02-01")}


def test_days_that_count_and_carried_benchmark(spark):
    comp = spark.createDataFrame([("U", i, f"2020-01-{i:02d}", i not in (1, 4)) for i in range(1, 8)], "universe string, session int, date string, data_ok boolean")
    days = RP.counted_days(comp)
    assert [(r.session, r.day) for r in days.orderBy("session").collect()] == [(1, 2), (2, 3), (3, 5), (4, 6), (5, 7)]
    bench = spark.createDataFrame([("U", "2020-01-01", 9.0), ("U", "2020-01-03", 1.0), ("U", "2020-01-04", 7.0), ("U", "2020-01-07", 2.0)], "universe string, date string, px double")
    # the value of a day that doesn't count is not carried
    assert [r.px for r in RP.carried(days, bench).orderBy("session").collect()] == [None, 1.0, 1.0, 1.0, 2.0]
    fired = spark.createDataFrame([("U", "2020-01-02", "zweig"), ("U", "2020-01-05", "zweig"), ("U", "2020-03-05", "zweig"), ("U", "2021-03-05", "zweig"), ("V", "2020-03-05", "d1")], "universe string, date string, detector string").selectExpr("universe", "to_date(date) as date", "detector")
    assert sorted(map(tuple, RP.silent_period(fired, "2020-01-01", "2020-12-31", few=2).collect())) == [("U", 3, 2, "LOOSER"), ("V", 0, 0, "CONSISTENT")]


def test_gate(spark):
    cells = spark.createDataFrame([("B", "sized", True), ("A", "sized", True), ("C", "literal", True)], "universe string, mode string, replicates boolean")
    assert tuple(RP.gate(cells).first()) == (["A", "B"], "REPLICATED")
    assert tuple(RP.gate(cells.where("mode = 'literal'")).first()) == ([], "NOT REPLICATED")


def test_joint_and_apart(spark):
    a = spark.createDataFrame([("k", f"2020-01-{i:02d}", float(i)) for i in range(1, 9)], "key string, date string, value double")
    b = spark.createDataFrame([("k", f"2020-01-{i:02d}", None if i == 8 else i + (0.5 if i in (2, 6) else 0.0)) for i in range(1, 9)], "key string, date string, value double")
    assert [(r.date, r["diff"]) for r in C.apart(a, b, 0.02, 3).collect()] == [("2020-01-06", 0.5)]
    assert C.joint(a.selectExpr("date", "value as x"), b.selectExpr("date", "value as y")).count() == 7
