"""Versioned documents and partitioned tables that are replaced whole: a reader sees what was there or what is new, and of several writers none is lost.

A version is a numbered file in a folder, and its number can be taken once. A writer
reads the last version and takes the next number for its own; where another was faster,
it reads again. A table's document names the folder of each of its parts, so files that
are read are never touched, and a part that isn't written keeps its files.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surgeline.sources.panel import upsert


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    fs, p = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text in one file, replacing what is there."""
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _taken(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a file where none is, whole or not at all; False where one is."""
    draft = f"{path}.{uuid.uuid4().hex}"
    write_text(spark, draft, text)
    fs, p = file_system(spark, draft)
    try:
        if fs.getUri().getScheme() == "file":  # whose rename replaces
            try:
                os.link(urlparse(draft).path, urlparse(path).path)
            except FileExistsError:
                return False
            return True
        to = file_system(spark, path)[1]
        return not fs.exists(to) and fs.rename(p, to)
    finally:
        fs.delete(p, False)


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The last version's number and document; 0 and an empty one where there is none."""
    found = sorted(n for n in names(spark, path) if n.endswith(".json"))
    if not found:
        return 0, {}
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(f"{path}/{found[-1]}").collect())
    return int(found[-1].removesuffix(".json")), json.loads(text)


def change(spark: SparkSession, path: str, new: Callable[[dict], dict]) -> dict:
    """Makes new(last document) the next version, and returns it. Called anew with what another writer put there meanwhile."""
    while True:
        number, document = latest(spark, path)
        document = new(document)
        if _taken(spark, f"{path}/{number + 1:012d}.json", json.dumps(document, separators=(",", ":"), default=str)):
            return document


def _generation(df: DataFrame, path: str, part: str) -> dict[str, str]:
    """Writes df to a new folder: the folder of each of its values of part."""
    folder = f"data/{uuid.uuid4().hex}"
    df.withColumn("part_", F.col(part).cast("string")).write.partitionBy("part_").parquet(f"{path}/{folder}")
    made = [n for n in names(df.sparkSession, f"{path}/{folder}") if n.startswith("part_=")]
    return {unquote(n.removeprefix("part_=")): f"{folder}/{n}" for n in made}


def replace_parts(df: DataFrame, path: str, part: str) -> dict:
    """Replaces the parts that df has, whole and at once, and leaves others. A writer that stops before its end has changed nothing."""
    made = _generation(df, path, part)
    return change(df.sparkSession, f"{path}/versions", lambda d: {"schema": df.schema.jsonValue(), "parts": d.get("parts", {}) | made})


def merge_parts(df: DataFrame, path: str, part: str, keys: list[str]) -> dict:
    """Merges rows by key into the parts that they touch, where df wins; files of other parts stay as they are. keys hold part. Of df's rows with one key, one counts."""
    spark = df.sparkSession
    touched = [r[0] for r in df.select(F.col(part).cast("string")).distinct().collect()]  # parts are few: months, or bases
    while True:
        _, before = latest(spark, f"{path}/versions")
        old = [before["parts"][p] for p in touched if p in before.get("parts", {})]
        rows = spark.read.schema(df.schema).parquet(*[f"{path}/{f}" for f in old]) if old else df.limit(0)
        made = _generation(upsert(rows, df, keys), path, part)
        lost = False

        def new(d: dict) -> dict:
            nonlocal lost
            lost = any(d.get("parts", {}).get(p) != before.get("parts", {}).get(p) for p in touched)
            return d if lost else {"schema": df.schema.jsonValue(), "parts": d.get("parts", {}) | made}

        out = change(spark, f"{path}/versions", new)
        if not lost:  # else another writer changed one of these parts: its rows count too
            return out


def read_parts(spark: SparkSession, path: str, parts: list[str] | None = None) -> DataFrame:
    """The table as it is now, or some of its parts; later writers don't change what was opened. A part that isn't there is an error."""
    _, document = latest(spark, f"{path}/versions")
    known = document.get("parts", {})
    for p in parts or ():
        if p not in known:
            raise ValueError(f"no {p!r} in {path}")
    folders = [f"{path}/{known[p]}" for p in (known if parts is None else parts)]
    if not document:
        raise ValueError(f"no table in {path}")
    schema = T.StructType.fromJson(document["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
