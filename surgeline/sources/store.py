"""Stores of series: a cache of panels in JSON, series by basis in Parquet, documents of results, and the page that shows one."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgeline.functions.chains import place
from surgeline.sources.panel import read_cache
from surgeline.sources.pull import SCHEMA, one_by_one, pull
from surgeline.sources.versions import change, file_system, latest, read_parts, replace_parts, write_text


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cache that save_cache wrote, a folder, or another one's file; no rows where there is none yet."""
    fs, p = file_system(spark, path)
    if fs.exists(p):
        return read_cache(spark, path, lines=fs.getFileStatus(p).isDirectory())
    return spark.createDataFrame([], "ticker string, date date, close double, volume long")


def save_cache(df: DataFrame, path: str, stamp: str) -> None:
    """Rows (ticker, date, close, volume) as JSON that load_cache reads, a line for each ticker."""
    series = F.sort_array(F.collect_list(F.struct("date", "close", "volume")))
    each = df.groupBy("ticker").agg(series.alias("s"))
    fields = F.struct(F.transform("s", lambda x: x["date"].cast("string")).alias("dates"), F.transform("s", lambda x: x["close"]).alias("adjClose"), F.transform("s", lambda x: x["volume"]).alias("volume"))
    each.select(F.create_map("ticker", fields).alias("tickers"), F.lit(stamp).alias("last_updated")).write.mode("overwrite").json(path)


def write_series(df: DataFrame, path: str, stamp: str) -> None:
    """Replaces the bases that df (basis, symbol, date, close, volume) has, whole and at once, and leaves others; the source's stamp goes along as a column."""
    replace_parts(df.withColumn("source_stamp", F.lit(stamp)), path, "basis")


def read_series(spark: SparkSession, path: str, basis: str | None = None) -> DataFrame:
    """The series of one basis, or of all; only its files are read. A basis that isn't there is an error, as other prices than those asked for are worse than none."""
    return read_parts(spark, path, None if basis is None else [basis])


def series_of(series: DataFrame, symbol: str, basis: str = "NONE") -> DataFrame:
    """(date, close) of one symbol, such as a benchmark or a vendor's indicator."""
    return series.where((F.col("symbol") == symbol) & (F.col("basis") == basis)).select("date", "close")


def refresh(spark: SparkSession, path: str, symbols: list[str], bases: list[str], fetch: Callable[[str, str], list[tuple]], stamp: str) -> dict:
    """Replaces every symbol on every basis by what fetch(symbol, basis) gives, rows (date, close, volume). Those that fail or are empty are listed, and left out.

    Tasks fetch and write batches of symbols; the driver has the failures alone. The
    store changes at the end, at once: what stops before it leaves the old one.
    """
    scratch = place(spark, "pulled")
    pull(spark, symbols, bases, one_by_one(fetch)).write.parquet(scratch)
    pulled = spark.read.schema(SCHEMA).parquet(scratch)
    failed = [(r.symbol, r.basis, r.failure) for r in pulled.where("failure is not null").collect()]
    rows = pulled.where("failure is null").drop("failure")
    if len(failed) < len(symbols) * len(bases):
        write_series(rows, path, stamp)
    fs, p = file_system(spark, scratch)
    fs.delete(p, True)
    return {"pulled": len(symbols) * len(bases) - len(failed), "failed": failed}


def read_document(spark: SparkSession, path: str) -> dict:
    """A document of JSON, or the last version of one that merge_document keeps; empty where there is none."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return {}
    if fs.getFileStatus(p).isDirectory():
        return latest(spark, path)[1]
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """A small document as JSON in one file, replacing what is there. NaN becomes null."""
    write_text(spark, path, json.dumps(scrubbed(document), separators=(",", ":"), default=str))


def scrubbed(x):
    """x with null for every NaN."""
    if isinstance(x, dict):
        return {k: scrubbed(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [scrubbed(v) for v in x]
    return None if isinstance(x, float) and x != x else x


def merge_document(spark: SparkSession, path: str, key: str, part: dict) -> dict:
    """Puts part under key in a document that several may write, a folder of versions, and keeps its other keys. NaN becomes null."""
    return change(spark, path, lambda d: d | {key: scrubbed(part)})


def render(template: str, document: dict, token: str = "__DATA__") -> str:
    """A page: the first token in the template gives way to the document; the page may name the token again."""
    return template.replace(token, json.dumps(scrubbed(document), separators=(",", ":"), default=str), 1)


def set_operations(a: DataFrame, b: DataFrame) -> DataFrame:
    """(symbol, part): symbols of either table, as in both, in a alone, or in b alone."""
    a, b = a.select("symbol"), b.select("symbol")
    tagged = lambda df, name: df.select("symbol", F.lit(name).alias("part"))
    return tagged(a.intersect(b), "both").union(tagged(a.subtract(b), "a")).union(tagged(b.subtract(a), "b"))
