"""What a run publishes: status, gauges, the last signal's path, and the whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgeline.operators import breadth as B
from surgeline.operators import study as E
from surgeline.params import HORIZONS, ThrustParams

#: (dimension, gauge, reading, flag): what is shown of each dimension.
GAUGES = [
    ("d1", "zweig", "zweig_line", "zweig"), ("d1", "deemer", "deemer_ratio", "deemer"), ("d1", "mcclellan", "mcc", "mcclellan"), ("d2", "above_average", "pct_above", "d2"),
    ("d3", "high_ratio", "high_ratio", "nhnl_ratio"), ("d3", "net_highs", "net_highs", "nhnl_net"), ("d4", "up_volume", "best_up", "d4"),
]


def triggers(p: ThrustParams) -> dict[str, tuple[float | None, float]]:
    """Where each gauge arms (None: it needn't) and fires."""
    return {
        "zweig": (p.zweig_low, p.zweig_high), "deemer": (None, p.deemer_ratio), "mcclellan": (p.mcc_floor * p.scale, 0.0), "above_average": (p.pct_low, p.pct_high),
        "high_ratio": (p.ratio_low, p.ratio_high), "net_highs": (0.0, p.net_highs * p.scale), "up_volume": (None, p.up_volume),
    }


def formation(comp: DataFrame, p: ThrustParams = ThrustParams()) -> DataFrame:
    """(universe, dimension, gauge, reading, arms, fires, fired, dimension_on) at the last session. comp has the lines, flags and memory."""
    from surgeline.functions.series import by, trailing

    df = comp.withColumn("best_up", F.max("up_volume_ratio").over(trailing(by("universe"), 5)))
    columns = dict.fromkeys([c for _, _, reading, flag in GAUGES for c in (reading, flag)] + [f"d{k}_on" for k in (1, 2, 3, 4)])
    last, at = B.latest(df, list(columns)), triggers(p)
    rows = [F.struct(F.lit(d).alias("dimension"), F.lit(g).alias("gauge"), F.col(reading).cast("double").alias("reading"), F.lit(at[g][0]).cast("double").alias("arms"), F.lit(at[g][1]).cast("double").alias("fires"), F.col(flag).alias("fired"), F.col(f"{d}_on").alias("dimension_on")) for d, g, reading, flag in GAUGES]
    return last.select("universe", F.inline(F.array(*rows)))


def signal_path(comp: DataFrame, bench: DataFrame) -> DataFrame:
    """(universe, event_date, day, ret): the benchmark since the session after the last event, day by day from 0; nothing without an event, or after the last session."""
    at = comp.where("event and n_dimensions >= 1").groupBy("universe").agg(F.max_by(F.struct("session", "date"), "session").alias("e")).select("universe", F.col("e.date").alias("event_date"), (F.col("e.session") + 1).alias("anchor"))
    rows = bench.join(at, "universe").where("session >= anchor")
    first = rows.where("session = anchor").select("universe", F.col("px").alias("first"))
    return rows.join(first, "universe").select("universe", "event_date", (F.col("session") - F.col("anchor")).alias("day"), (F.col("px") / F.col("first") - 1.0).alias("ret"))


def timeline_arrays(comp: DataFrame, bench: DataFrame) -> DataFrame:
    """A row for each universe: parallel arrays by session in the valid window."""
    rows = E.in_window(comp).join(bench.select("universe", "session", F.round("px", 2).alias("px")), ["universe", "session"], "left")
    names = ["date", "px", "n_dimensions", "d1_on", "d2_on", "d3_on", "d4_on", "event"]
    sorted_ = F.sort_array(F.collect_list(F.struct("session", *names)))
    return rows.groupBy("universe").agg(sorted_.alias("t")).select("universe", *[F.col(f"t.{c}").alias(c) for c in names])


def from_arrays(record: DataFrame, names: list[str]) -> DataFrame:
    """Parallel arrays to rows."""
    return record.select("universe", F.inline(F.arrays_zip(*names)))


def documents(comp: DataFrame, bench: DataFrame, study: DataFrame, p: ThrustParams, survivorship_bias: bool) -> DataFrame:
    """A row for each universe with the parts of its document: current, formation, last_signal, study, timeline. Parts are of dates and cells, so small."""
    current = B.latest(comp, ["n_dimensions", "score", "valid_count", "data_ok", "d1_on", "d2_on", "d3_on", "d4_on"]).select("universe", F.struct(F.col("date").alias("as_of"), "n_dimensions", "score", "valid_count", "data_ok", "d1_on", "d2_on", "d3_on", "d4_on").alias("current"))
    packed = lambda df, name: df.groupBy("universe").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "universe"]))).alias(name))
    window, inside = E.in_window(comp), E.in_window(comp).select("universe", "session")
    signal = E.last_signal(window, bench.join(inside, ["universe", "session"], "left_semi"), HORIZONS)
    signal = signal.select("universe", F.struct(*[c for c in signal.columns if c != "universe"]).alias("last_signal"))
    arrays = timeline_arrays(comp, bench)
    arrays = arrays.select("universe", F.struct(*[c for c in arrays.columns if c != "universe"]).alias("timeline"))
    out = current.withColumn("survivorship_bias", F.lit(survivorship_bias)).withColumn("memory_days", F.lit(p.memory))
    for part in (packed(formation(comp, p), "formation"), signal, packed(study, "study"), arrays):
        out = out.join(part, "universe", "left")
    return out
