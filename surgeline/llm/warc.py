"""WARC archives: written from a table, and read back by verifying the chain of record boundaries.

Archives are plain text files to Spark's writer, a record a row, with the line
separator that ends a record. To its reader the line separator is the magic that
begins one, so a row is what stands between two magics, wherever the file was split.
A magic may as well stand in a payload. A task therefore emits for each candidate the
offset of its successor, by its Content-Length, and follows these within its part of
the file. Pointer jumping between the parts, from the file's start, tells in about
log2(parts) rounds where the chain enters each; a second scan walks on from there and
returns the records, so that no task needs more than its part. Only a record with
magics inside that reaches into other parts is put together by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surgeline.llm.shared import Scratch, maybe_broadcast, small, tune

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
#: Payloads from this size on are stored once.
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Parts of files whose places are broadcast; more are joined by a shuffle.
PARTS = 500_000


def _line(name: str, *value) -> Column:
    """A header line; none where a value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n")), F.lit(""))


def _name(id_col: Column) -> Column:
    """A record's id; a null id is an empty name."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(id_col.cast("string")), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record for each row of pages to archives in a new folder, one for each task.

    Of rows with equal payloads (by SHA-1) of at least so many bytes, that with the largest
    id is a response and others revisit it; all other rows are responses. Rows that tie for
    the largest id are responses, all of them, as are rows without an id where no
    row of the group has one; else a null id is the least. A null payload is empty; a null
    url has no header, and spaces and line breaks in one are escaped. An empty table makes an empty
    folder. Payloads are stored whole; other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    again = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    rows = rows.join(maybe_broadcast(again, 200_000), "digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    url = F.col("url")
    for character, escaped in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        url = F.replace(url, F.lit(character), F.lit(escaped))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    stored = F.when(revisit, "").otherwise(F.col("payload"))
    head = F.concat(
        F.lit(MAGIC), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", _name(F.col("id"))), _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest")), _line("WARC-Profile", F.when(revisit, PROFILE)), _line("WARC-Refers-To", F.when(revisit, _name(F.col("last")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", F.octet_length(http) + F.octet_length(stored)), F.lit("\r\n"),
    )
    rows.select(F.concat(head, http, stored)).write.option("lineSep", END).text(path)


def _field(header: Column, name: str) -> Column:
    """The value of a header's first field of a name; null where it has none."""
    found = F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|$)", 1)
    return F.when(found != "", found)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """(f, part, path, value): what stands between two magics, in the order of each part of a file."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    at = F.col("_metadata.file_path")
    return rows.select(F.xxhash64(at).alias("f"), F.col("_metadata.file_block_start").alias("part"), at.alias("path"), "value")


def successors(batches):
    """Arrow function: (f, part, size, head, length), in order, to (f, part, pos, exit).

    A row for each candidate: its position, and the first position outside the part on
    the chain of its successors, or one in the part where no candidate is. Another for each
    part, with pos -1 and the part's length. Positions are just after the magic, relative to the part's first row.
    """
    import pyarrow as pa

    key, end, places, following = None, 0, [], []

    def close():
        exits: dict[int, int] = {}
        for p, n in zip(reversed(places), reversed(following)):
            exits[p] = exits.get(n, n)
        pos, out = [-1, *exits], [end, *exits.values()]
        return pa.RecordBatch.from_arrays([pa.array([k] * len(pos), pa.int64()) for k in key] + [pa.array(pos, pa.int64()), pa.array(out, pa.int64())], ["f", "part", "pos", "exit"])

    for batch in batches:
        for f, part, size, head, length in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (f, part) != key:
                if key is not None:
                    yield close()
                key, end, places, following = (f, part), 0, [], []
            if length is not None and (part or end):  # what stands before a file's first magic is no candidate
                places.append(end)
                following.append(end + head + len(END) + length + len(END) + len(MAGIC))
            end += size + len(MAGIC)
    if key is not None:
        yield close()


def reached_from(start: DataFrame, jumps: DataFrame, scratch: Scratch) -> DataFrame:
    """(f, pos) of all that chains of jumps (f, pos, exit) lead to from start (f, pos), itself included, by pointer jumping."""
    reached, n = scratch.table(start), -1
    while (m := reached.count()) > n:
        n = m
        step = reached.join(jumps, ["f", "pos"]).select("f", F.col("exit").alias("pos"))
        further = jumps.select("f", F.col("pos").alias("exit"), F.col("exit").alias("next"))
        twice = jumps.join(further, ["f", "exit"], "left").select("f", "pos", F.coalesce("next", "exit").alias("exit"))
        before = (reached, jumps)
        reached, jumps = scratch.table(reached.union(step).distinct()), scratch.table(twice)
        scratch.drop(*before)
    return reached


def verified_parts(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """(f, part, base, entry) of each part with rows: the offset of its first row, and the relative position where the chain from the file's start enters it, null where it doesn't."""
    header = F.substring_index("value", END, 1)
    rows = _rows(spark, path).select("f", "part", F.octet_length("value").alias("size"), F.octet_length(header).alias("head"), _field(header, "Content-Length").alias("length"))
    rows = rows.withColumn("length", F.when(F.col("head") < F.col("size"), F.col("length").try_cast("long")))
    found = scratch.table(rows.mapInArrow(successors, "f long, part long, pos long, exit long"))
    before = Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.table(found.where("pos < 0").select("f", "part", "exit", F.coalesce(F.sum("exit").over(before), F.lit(0)).alias("base")))
    some = maybe_broadcast(parts.select("f", "part", "base"), PARTS)
    nodes = found.where("pos >= 0").join(some, ["f", "part"]).select("f", "part", "base", (F.col("pos") + F.col("base")).alias("pos"), (F.col("exit") + F.col("base")).alias("exit"))
    first = F.lit(len(MAGIC)).cast("long")
    starts = parts.select("f", first.alias("pos")).distinct()
    wanted = scratch.table(nodes.select("f", F.col("exit").alias("pos")).union(starts).distinct())  # a few for each part
    nodes = scratch.table(nodes.join(maybe_broadcast(wanted, PARTS), ["f", "pos"], "left_semi"))
    reached = reached_from(starts, scratch.table(nodes.select("f", "pos", "exit")), scratch)
    ends = parts.groupBy("f").agg(F.max(F.col("base") + F.col("exit")).alias("pos"))
    for r in ends.join(reached, ["f", "pos"], "left_anti").limit(1).collect():
        name = _rows(spark, path).where(F.col("f") == r.f).select("path").first()[0]
        raise ValueError(f"{name} is not a chain of whole records from its start to its end")
    entries = nodes.join(maybe_broadcast(reached, PARTS), ["f", "pos"], "left_semi").select("f", "part", (F.col("pos") - F.col("base")).alias("entry"))
    return scratch.table(parts.select("f", "part", "base").join(entries, ["f", "part"], "left"))


def walked(whole: bool):
    """Arrow function: (path, f, part, base, entry, value), in order, to (path, f, part, place, pos, data): the records that end in their part or, where whole is False, pieces of the others, place 0 for what reaches in and 1 for what reaches out."""
    import pyarrow as pa

    names = ["path", "f", "part", "place", "pos", "data"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    magic = MAGIC.encode()

    def run(batches):
        here, kept, cols = None, [], [[] for _ in names]

        def put(data):
            for c, x in zip(cols, (*here, place, at, b"".join(data))):
                c.append(x)

        def taken():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for path, f, part, base, entry, value in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (path, f, part) != here:
                    if kept and not whole:
                        put(kept)
                    here, end, kept, place, at = (path, f, part), 0, [], 0, base
                if end == entry and kept:
                    if not whole:
                        put(kept)
                    kept = []
                if entry is None or end < entry:
                    if part or end:
                        kept += [value, magic]
                else:
                    if not kept:
                        head = value.find(END.encode())
                        place, at, missing = 1, base + end, head + content_length(value[:head]) + 2 * len(END)
                    kept += [value, magic]
                    missing -= len(value)
                    if missing:
                        missing -= len(magic)
                    else:
                        if whole:
                            put(kept[:-1])
                        kept = []
                end += len(value) + len(magic)
            yield taken()
        if kept and not whole:
            put(kept)
            yield taken()

    return run


def content_length(header: bytes) -> int:
    """The header's Content-Length, as the first scan read it."""
    for line in header.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length" and value.strip(b" \t"):
            return int(value.strip(b" \t"))
    raise ValueError("a record of the chain has no Content-Length")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder: (path, offset, header, block), one row each; block is binary.

    Offsets are in bytes. A magic in a payload, with a whole record after it or not, is
    part of that payload. Empty files have no records. Raises ValueError for a file that isn't
    a chain of whole records, as one that was cut short. A record is a row, so it has under 2 GB.
    """
    tune(spark)
    scratch = Scratch(spark, "warc")
    parts = verified_parts(spark, path, scratch)
    few = small(parts, PARTS)
    rows = _rows(spark, path).withColumn("at", F.monotonically_increasing_id())
    rows = rows.join(F.broadcast(parts) if few else parts, ["f", "part"])
    if not few:
        rows = rows.repartition("f", "part").sortWithinPartitions("f", "part", "at")
    rows = rows.select("path", "f", "part", "base", "entry", F.col("value").cast("binary"))
    schema = "path string, f long, part long, place int, pos long, data binary"
    out = rows.mapInArrow(walked(True), schema).select("path", "pos", "data")
    first = F.when(F.col("part") == 0, len(MAGIC)).otherwise(0)
    if not parts.where(F.col("entry").isNull() | (F.col("entry") > first)).isEmpty():  # some record with magics inside reaches into other parts
        pieces = scratch.table(rows.mapInArrow(walked(False), schema))
        order = Window.partitionBy("f").orderBy("part", "place")
        pieces = pieces.withColumn("record", F.sum("place").over(order))
        one = pieces.groupBy("path", "f", "record").agg(F.sort_array(F.collect_list(F.struct("part", "place", "data"))).alias("parts"), F.max(F.when(F.col("place") == 1, F.col("pos"))).alias("pos"))
        out = out.union(one.select("path", "pos", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.data))").alias("data")))
    header = F.substring_index(F.col("data").cast("string"), END, 1)
    out = out.select("path", (F.col("pos") - len(MAGIC)).alias("offset"), header.alias("header"), "data")
    block = F.substring(F.col("data"), F.octet_length("header") + len(END) + 1, _field(F.col("header"), "Content-Length").cast("int"))
    return out.select("path", "offset", "header", block.alias("block"))


def payloads(records: DataFrame, id_type: str = "long") -> DataFrame:
    """Of what write_archives wrote: (id, url, record_type, refers_to, payload_bytes, payload_digest, payload), a row for each record.

    A revisit has no payload of its own; its size and digest are those of the response.
    A payload that differs from its record's digest is an error. An empty name is a null id.
    """
    header = F.col("header")

    def ident(field):
        name = F.regexp_extract(_field(header, field), "^<urn:page:(.*)>$", 1)
        return F.url_decode(F.when(name != "", name)).cast(id_type)

    http = F.substring_index(F.col("block").cast("string"), END, 1)
    rows = records.select(ident("WARC-Record-ID").alias("id"), _field(header, "WARC-Target-URI").alias("url"), _field(header, "WARC-Type").alias("record_type"), ident("WARC-Refers-To").alias("refers_to"), F.substring(_field(header, "WARC-Payload-Digest"), 6, 40).alias("said"), http.alias("http"), "block")
    revisit = F.col("record_type") == "revisit"
    payload = F.when(~revisit, F.substring(F.col("block"), F.octet_length("http") + len(END) + 1, F.octet_length("block")))
    rows = rows.withColumn("payload", payload).withColumn("digest", F.coalesce(F.sha1("payload"), F.col("said")))
    size = F.coalesce(F.octet_length("payload"), _field(F.col("http"), "Content-Length").cast("int")).cast("long")
    digest = F.when(F.col("digest") == F.col("said"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("said"))))
    return rows.select("id", "url", "record_type", "refers_to", size.alias("payload_bytes"), digest.alias("payload_digest"), "payload")
