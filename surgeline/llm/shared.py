"""Session helpers of the training-data operators: shared scratch tables and Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch: whole texts are long, so the default of 10,000 rows may not fit a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 64 << 20


def tune(spark: SparkSession) -> None:
    """Lowers the Arrow batch sizes of the session where they are larger than BATCH_ROWS and BATCH_BYTES, and lets Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub("[^0-9]", "", spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one will do in a session of one process, and nowhere else."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


_owner: ContextVar["list[Scratch] | None"] = ContextVar("owner", default=None)


@contextmanager
def owned():
    """Tables that this thread's operators write inside are deleted at the end, so what is made of them must be written by then. An owner inside another has its own; other threads' tables are theirs."""
    made: list[Scratch] = []
    token = _owner.set(made)
    try:
        yield
    finally:
        _owner.reset(token)
        for s in made:
            s.clear()


class Scratch:
    """Tables written to the shared folder, which cut lineage: lost executors lose none of them.

    What an operator returns may still read its tables, so it drops only those that
    nothing reads; who writes the result does so inside owned(), which deletes the rest.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0
        if (made := _owner.get()) is not None:
            made.append(self)

    def clear(self) -> None:
        """Deletes all its tables."""
        self._delete(self.root)

    def place(self) -> str:
        """A new path in the shared folder."""
        self.n += 1
        return f"{self.root}/{self.n}"

    def table(self, df: DataFrame) -> DataFrame:
        """Writes df as Parquet and reads it again."""
        path = self.place()
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            self._delete(t.scratch_path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint where its measured size is within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


def whole_row(df: DataFrame) -> "F.Column":
    """All columns of df as one, named doc, so that no names clash."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("doc")


def held_out(doc_id) -> "F.Column":
    """crc32(doc_id as text) mod 3 = 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array, and its n + 1 offsets; nulls are empty texts."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def doc_chunks(offs: np.ndarray, limit: int = 1 << 20):
    """Ranges (i, j) of whole documents with about limit bytes each; a longer document stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
