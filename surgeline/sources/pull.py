"""Series pulled from a source outside Spark, in batches of symbols that tasks fetch on their own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

#: Symbols that a task asks for at a time.
BATCH = 40
SCHEMA = "basis string, symbol string, date date, close double, volume long, failure string"
#: Rows that a task hands on at a time.
ROWS = 10_000


def one_by_one(fetch: Callable[[str, str], Iterable[tuple]]):
    """A source of batches from one that gives the rows (date, close, volume) of a symbol on a basis."""

    def batch(symbols, basis):
        for symbol in symbols:
            try:
                yield symbol, list(fetch(symbol, basis))
            except Exception as e:  # noqa: BLE001  a source may fail in any way
                yield symbol, e

    return batch


def pull(spark: SparkSession, symbols: list[str], bases: list[str], source: Callable[[list[str], str], Iterable[tuple]], batch: int = BATCH) -> DataFrame:
    """Every symbol on every basis, as pull_batches gives it. A partition is a batch."""
    asked = [(b, symbols[i : i + batch]) for b in bases for i in range(0, len(symbols), batch)]
    rows = spark.sparkContext.parallelize(asked, max(1, len(asked)))  # a task is sent its own batch, and no other
    return pull_batches(spark.createDataFrame(rows, "basis string, symbols array<string>"), source, batch)


def pull_batches(asked: DataFrame, source: Callable[[list[str], str], Iterable[tuple]], batch: int = BATCH) -> DataFrame:
    """asked (basis, symbols): rows (basis, symbol, date, close, volume), and for what failed one with the failure and nothing else.

    source(symbols, basis) gives pairs of a symbol and its rows (date, close, volume), or an
    exception; it is asked for batch symbols at most. A symbol without rows failed as empty;
    where source itself fails, so did all symbols of the batch that it had not given. What a
    lost task asked for is fetched again.
    """

    def fetched(basis, wanted):
        waiting, why = dict.fromkeys(wanted), "empty"
        try:
            for symbol, rows in source(list(wanted), basis):
                if symbol in waiting and (isinstance(rows, Exception) or rows):
                    del waiting[symbol]
                    if isinstance(rows, Exception):
                        yield basis, symbol, None, None, None, str(rows)
                    else:
                        for date, close, volume in rows:
                            yield basis, symbol, date, close, volume, None
        except Exception as e:  # noqa: BLE001
            why = str(e)
        for symbol in waiting:
            yield basis, symbol, None, None, None, why

    def run(batches):
        from itertools import islice

        import pyarrow as pa

        names = ["basis", "symbol", "date", "close", "volume", "failure"]
        kinds = [pa.string(), pa.string(), pa.date32(), pa.float64(), pa.int64(), pa.string()]
        for x in batches:
            for basis, symbols in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                for i in range(0, len(symbols), batch):
                    rows = fetched(basis, symbols[i : i + batch])
                    while some := list(islice(rows, ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    return asked.mapInArrow(run, SCHEMA)
