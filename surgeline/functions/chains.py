"""Chains along a key's places, for keys of any size: stretches, successors, and what is reached from a start.

A key's places are dealt out in blocks that overlap as far as a rule looks, so that no
task takes a whole key; what crosses blocks is a row for each block, or pointer jumping.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places of a block.
WIDTH = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one will do in a session of one process, and nowhere else."""
    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _block(at, size: int):
    return F.floor(at / size)


def islands(rows: DataFrame, keys: list[str], order: str, gap: int) -> DataFrame:
    """rows with island, the first place of the stretch that a row lies in; places more than gap apart are in two. order is an integer and has no nulls."""
    size, x = max(WIDTH, 4 * gap), F.col(order)
    own = rows.select(*keys, x.alias("x_")).distinct().withColumn("block_", _block(F.col("x_"), size))
    seen = own.select("*", F.lit(True).alias("own_")).union(own.select(*keys, "x_", _block(F.col("x_") + gap, size).alias("block_"), F.lit(False)).where(f"block_ <> floor(x_ / {size})"))
    w = Window.partitionBy(*keys, "block_").orderBy("x_")
    marked = seen.withColumn("start_", F.when(F.coalesce(F.col("x_") - F.lag("x_").over(w) > gap, F.lit(True)), F.col("x_"))).where("own_")
    marked = marked.withColumn("here_", F.last("start_", ignorenulls=True).over(w))
    blocks = marked.groupBy(*keys, "block_").agg(F.max("start_").alias("last_"))
    before = blocks.select(*keys, "block_", F.max("last_").over(Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)).alias("before_"))
    found = marked.join(before, [*keys, "block_"]).select(*keys, F.col("x_").alias(order), F.coalesce("here_", "before_").alias("island"))
    return rows.join(found, [*keys, order])


def successors(places: DataFrame, keys: list[str], order: str, gap: int) -> DataFrame:
    """places (keys, order), each once, with next, the first place more than gap and at most 2 * gap later. Inside an island of gap, that is the first more than gap later."""
    size, x = max(WIDTH, 4 * gap), F.col(order)
    own = places.select(*keys, order, _block(x, size).alias("block_"), F.lit(True).alias("own_"))
    seen = own.union(own.select(*keys, order, _block(x - 2 * gap, size).alias("block_"), F.lit(False)).where(f"block_ <> floor({order} / {size})"))
    w = Window.partitionBy(*keys, "block_").orderBy(order).rangeBetween(gap + 1, 2 * gap)
    return seen.withColumn("next", F.min(order).over(w)).where("own_").select(*keys, order, "next")


def reached(starts: DataFrame, jumps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order) of all that chains of jumps (keys, order, next) lead to from starts (keys, order), themselves included. Each round doubles the jumps, so there are about log2 of the longest chain's length."""
    done, jumps, n = cut(starts.select(*keys, order)), cut(jumps.where("next is not null")), -1
    while (m := done.count()) > n:
        n = m
        step = done.join(jumps, [*keys, order]).select(*keys, F.col("next").alias(order))
        further = jumps.select(*keys, F.col(order).alias("next"), F.col("next").alias("after_"))
        done = cut(done.union(step).distinct())
        jumps = cut(jumps.join(further, [*keys, "next"]).select(*keys, order, F.col("after_").alias("next")))
    return done
