"""Time-series functions over gap-free sessions: expressions for a window, and the two that need several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(*keys: str, order: str = "session"):
    return Window.partitionBy(*keys).orderBy(order)


def running(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def trailing(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


def rolling_sum(x: Column, w, n: int) -> Column:
    """Sum of the last n rows, null before there are n values; for integers, by two running sums."""
    total, count = F.sum(x).over(running(w)), F.count(x).over(running(w))
    before = F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -n)), F.lit(0))
    seen = F.coalesce(F.count(x).over(w.rowsBetween(Window.unboundedPreceding, -n)), F.lit(0))
    return F.when(count - seen == n, total - before)


def full(value: Column, x: Column, w, n: int) -> Column:
    """value where all of the last n rows have x."""
    return F.when(F.count(x).over(trailing(w, n)) == n, value)


def any_within(flag: Column, w, n: int, order: str = "session") -> Column:
    """Whether flag held in the last n sessions, this one included."""
    last = F.last(F.when(flag, F.col(order)), ignorenulls=True).over(running(w))
    return F.coalesce(F.col(order) - last < n, F.lit(False))


def crossed_up(x: Column, low: float, high: float, w, n: int) -> Column:
    """x is over high now and was under low in the last n sessions."""
    return F.coalesce(x > high, F.lit(False)) & any_within(F.coalesce(x < low, F.lit(False)), w, n)


def edges(flag: Column, w) -> Column:
    """The flag's first session of each stretch."""
    return flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))


def filled(x: Column, w) -> Column:
    return F.last(x, ignorenulls=True).over(running(w))


def block_extremes(df: DataFrame, keys: list[str], x: str, n: int, high: str, low: str, order: str = "pos") -> DataFrame:
    """Adds the largest and smallest of the last n rows (null before there are n) in time per row that doesn't depend on n.

    Rows of a key are numbered from 1 in order. Blocks of n rows have running
    extremes from either end; a window spans the end of one block and the start of the next.
    """
    df = df.withColumn("block_", F.expr(f"({order} - 1) div {n}"))
    ahead = Window.partitionBy(*keys, "block_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys, "block_").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("*", F.max(x).over(ahead).alias("pmax_"), F.min(x).over(ahead).alias("pmin_")).select("*", F.max(x).over(behind).alias("smax_"), F.min(x).over(behind).alias("smin_"))
    w = Window.partitionBy(*keys).orderBy(order)
    ok = F.col(order) >= n
    return df.select("*", F.when(ok, F.greatest("pmax_", F.lag("smax_", n - 1).over(w))).alias(high), F.when(ok, F.least("pmin_", F.lag("smin_", n - 1).over(w))).alias(low)).drop("block_", "pmax_", "pmin_", "smax_", "smin_")


def ema(df: DataFrame, keys: list[str], columns: dict[str, tuple[str, int]], order: str = "session") -> DataFrame:
    """Adds exponential means {name: (column, span)} that start at the first value; over missing values the mean stays and its weight decays.

    A value turns the mean before it into a * mean + b. Such maps are composed in doubling
    steps, over 1, 2, 4, ... values, until what is left of older ones is under 1e-18 of
    them; so the number of steps depends on the span alone, and all of them are windows of one order.
    """
    w = by(*keys, order=order)
    out = df.withColumn("row_", F.row_number().over(w))
    for column in dict.fromkeys(c for c, _ in columns.values()):
        x = F.col(column).cast("double")
        out = out.withColumn("x_", F.when(~F.isnan(x), x)).withColumn("has_", F.col("x_").isNotNull())
        v = by(*keys, "has_", order=order)
        out = out.withColumn("gap_", F.col("row_") - F.lag("row_").over(v))
        for name, span in ((n, s) for n, (c, s) in columns.items() if c == column):
            new = 2.0 / (span + 1)
            old = F.pow(F.lit(1.0 - new), F.col("gap_"))
            first = F.col("gap_").isNull()
            out = out.withColumn("a_", F.when(first, 0.0).otherwise(old / (old + new))).withColumn("b_", F.when(first, F.col("x_")).otherwise(new * F.col("x_") / (old + new)))
            values = 1
            while new < 1 and (1.0 - new) ** values > 1e-18:
                a, b = F.coalesce(F.lag("a_", values).over(v), F.lit(0.0)), F.coalesce(F.lag("b_", values).over(v), F.lit(0.0))
                out = out.withColumns({"a_": F.col("a_") * a, "b_": F.col("a_") * b + F.col("b_")})
                values *= 2
            out = out.withColumn(name, filled(F.when(F.col("has_"), F.col("b_")), w))
    return out.select(*df.columns, *columns)
