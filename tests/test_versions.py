"""Stores that are replaced at once, merged by part, and written by several."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest

from surgeline.sources import store, versions
from surgeline.sources.pull import BATCH, pull

DAY = dt.date(2020, 1, 1)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_pull_is_dealt_out_in_batches_and_failures_are_rows(spark):
    def source(symbols, basis):
        assert len(symbols) <= BATCH
        for s in symbols:
            if s == "s3":
                yield s, OSError("no answer")
            elif s == "s50" and basis == "B":
                raise OSError("line is down")
            elif s != "s7":
                yield s, [(DAY, float(len(symbols)), 1)]

    df = pull(spark, [f"s{i}" for i in range(90)], ["A", "B"], source)
    assert df.rdd.getNumPartitions() == 6
    rows = df.collect()
    assert len(rows) == 180 and sum(r.failure is None for r in rows) == 88 + 58
    failed = {(r.basis, r.symbol): r.failure for r in rows if r.failure}
    assert failed["A", "s3"] == "no answer" and failed["A", "s7"] == "empty" and failed["B", "s79"] == "line is down" and ("B", "s45") not in failed
    assert pull(spark, [], ["A"], source).count() == 0


def test_a_refresh_that_dies_halfway_leaves_the_old_store(spark, tmp_path):
    path = str(tmp_path / "s")
    good = lambda symbol, basis: [(DAY, 1.0, 1)]

    def dies(symbol, basis):
        if symbol == "b":
            raise SystemExit(1)
        return [(DAY, 9.0, 9)]

    assert store.refresh(spark, path, ["a", "b"], ["NONE"], good, "old")["pulled"] == 2
    opened = store.read_series(spark, path, "NONE")
    with pytest.raises(Exception):
        store.refresh(spark, path, ["a", "b"], ["NONE"], dies, "new")
    assert {(r.symbol, r.close, r.source_stamp) for r in store.read_series(spark, path, "NONE").collect()} == {("a", 1.0, "old"), ("b", 1.0, "old")}
    # one that writes its data and stops before the end has changed nothing either
    rows = spark.createDataFrame([("NONE", "z", 5.0)], "basis string, symbol string, close double")
    versions._generation(rows, path, "basis")
    assert store.read_series(spark, path).count() == 2
    store.refresh(spark, path, ["c"], ["NONE"], good, "newer")
    assert [r.symbol for r in store.read_series(spark, path, "NONE").collect()] == ["c"]
    assert {r.symbol for r in opened.collect()} == {"a", "b"}  # a reader keeps what it opened


def test_two_writers_lose_no_key(spark, tmp_path):
    path = "file://" + str(tmp_path / "doc")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: store.merge_document(spark, path, f"k{k % 9}", {"v": k % 9}), range(18)))
    assert store.read_document(spark, path) == {f"k{k}": {"v": k} for k in range(9)}
    assert versions.latest(spark, path)[0] == 18


def test_merges_touch_their_parts_alone(spark, tmp_path):
    path, kind = tmp_path / "t", "month string, ticker string, px double, note string"
    row = lambda m, t, p: (m, t, p, None)
    first = spark.createDataFrame([row("2020-01", "a", 1.0), row("2020-02", "a", 2.0), row("2020-02", "b/ =%", 3.0), row("2020-03 x/y", "a", 4.0)], kind)
    versions.merge_parts(first, str(path), "month", ["month", "ticker"])
    before, opened = files(path), versions.read_parts(spark, str(path))
    versions.merge_parts(spark.createDataFrame([row("2020-02", "a", 9.0), row("2020-04", "c", 5.0), row("2020-04", "c", 5.0)], kind), str(path), "month", ["month", "ticker"])
    after = files(path)
    assert all(after[f] == t for f, t in before.items())
    got = {(r.month, r.ticker): r.px for r in versions.read_parts(spark, str(path)).collect()}
    assert got == {("2020-01", "a"): 1.0, ("2020-02", "a"): 9.0, ("2020-02", "b/ =%"): 3.0, ("2020-03 x/y", "a"): 4.0, ("2020-04", "c"): 5.0}
    used = versions.latest(spark, f"{path}/versions")[1]["parts"]
    assert sum(any(f.startswith(p) for f in before) for p in used.values()) == 2  # two months keep their files
    assert opened.count() == 4 and versions.read_parts(spark, str(path), ["2020-04"]).count() == 1
    with pytest.raises(ValueError, match="2031"):
        versions.read_parts(spark, str(path), ["2031"])
    with pytest.raises(ValueError, match="no table"):
        versions.read_parts(spark, str(tmp_path / "none"))


def test_merges_of_one_part_at_a_time_lose_no_row(spark, tmp_path):
    path = str(tmp_path / "t")
    one = lambda k: spark.createDataFrame([("m", f"t{k}", float(k))], "month string, ticker string, px double")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: versions.merge_parts(one(k), path, "month", ["month", "ticker"]), range(6)))
    assert sorted(r.ticker for r in versions.read_parts(spark, path).collect()) == [f"t{k}" for k in range(6)]
