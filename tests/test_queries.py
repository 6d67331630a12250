"""Queries against DuckDB on the driver's tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["panel_filled", "upsert_merge", "membership_masked_breadth", "breadth_counts", "composite_score", "conditional_table", "lift_table", "quartile_events", "anchor_match", "backtest_equity", "variant_grid", "pair_stats", "edge_compare", "edge_summary", "roster_validation", "payload_guard", "session_lag", "event_match_5", "one_sided_events", "rotation_null", "forward_max_drawdown", "last_signal"]
NAMES += ["reference_curves", "era_deltas", "silent_period", "bond_proxy_check", "formation_gauges", "last_signal_path", "filed_record", "benchmark_filled", "joint_frame", "symbol_sets", "readiness_rules", "roster_sync", "raw_count_lines", "zweig_tolerance", "stamp_age_days", "synthetic_run"]
NAMES += ["panel_cache", "series_pull", "series_store", "snapshots_json", "merged_document", "cluster_count", "decision_rule", "bootstrap_slope", "replication_gate", "zweig_ema10", "h2_level_contrast"]


def rows(df):
    cols = sorted(df.columns)
    text = lambda v: "" if v is None or v is pd.NaT or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v)
    return cols, sorted(tuple(text(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, D).toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).fetch_df())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70
