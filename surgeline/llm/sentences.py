"""Substring dedup by sliding sentence spans.

Every run of RUN or more consecutive sentences with WORDS words is hashed; runs
meet in a global join, and sentences that a run covers which stood anywhere
before are removed. Sentences end at . ! ? or a line end; one of more than LONG words counts
as several, so that long sentences are compared in parts. As such parts shift with the words
before them, long sentences are cut a second time, at places that the words themselves
determine, and runs from these cuts are hashed too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgeline.llm import kernels as K
from surgeline.llm.shared import Scratch, doc_chunks, text_bytes, tune

U = np.uint64
RUN, WORDS, LONG = 3, 12, 12
#: A long sentence is cut before the word of least hash in every NEAR consecutive ones, so a stretch of RUN * LONG + 3 * NEAR - 2 words in it meets its like whatever stands before.
NEAR = 5
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?"]] = True


def sentences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many documents: first byte of each word, first word of each sentence's parts (the number of words at the end), first word of each sentence, each document's first word (n + 1), and the words' hashes."""
    lower = K.LOWER[data]
    starts, ends, first = K.word_spans(lower, offs)
    words = K.span_hash(K.prefix_hash(lower), starts, ends)
    n = len(starts)
    lines = np.r_[0, np.cumsum(data == 10)]
    new = np.zeros(n, bool)
    new[1:] = ENDS[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    new[first[:-1][np.diff(first) > 0]] = True
    head = np.flatnonzero(new)
    size = np.diff(np.r_[head, n])
    within = np.arange(n) - np.repeat(head, size)
    return starts, np.r_[np.flatnonzero(within % LONG == 0), n], head, first, words


def cuts(head: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Words before which a run may begin or end: first words of sentences, and in long ones the last of the words of least hash among every NEAR; the number of words at the end."""
    n = len(words)
    cut = np.zeros(n + 1, bool)
    cut[head] = cut[n] = True
    size = np.diff(np.r_[head, n])
    if n >= NEAR:
        view = np.lib.stride_tricks.sliding_window_view(words, NEAR)[:, ::-1]
        inside = np.arange(len(view)) + NEAR <= np.repeat(head + size, size)[: len(view)]
        at = np.flatnonzero(inside & np.repeat(size > LONG, size)[: len(view)])
        cut[at + NEAR - 1 - view[at].argmin(1)] = True
    return np.flatnonzero(cut)


def cut_runs(head: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the shortest run from each cut to a cut with RUN parts and WORDS words, where it has words of a long sentence. What a run has of a sentence counts as one part, or as one for each LONG full words."""
    n = len(words)
    at = cuts(head, words)
    bounds = np.r_[head, n]
    size = np.diff(bounds)
    parts = np.maximum(1, size // LONG)
    before = np.r_[0, np.cumsum(parts)]
    of = np.searchsorted(head, at, "right") - 1
    of[-1] = len(head)
    behind = at - bounds[of]
    upto = before[of] + np.where(behind > 0, np.maximum(1, behind // LONG), 0)
    at, of, ends = at[:-1], of[:-1], at
    left = bounds[of + 1] - at
    own = np.maximum(1, left // LONG)
    here = np.searchsorted(ends, at + RUN * LONG, "left")
    far = np.maximum(np.searchsorted(upto, before[of + 1] + RUN - own, "left"), np.searchsorted(ends, at + WORDS, "left"))
    j = np.where(left >= RUN * LONG, here, far)
    stop = first[np.searchsorted(first, at, "right")]
    ok = j < len(ends)
    end = ends[np.minimum(j, len(ends) - 1)]
    long = np.r_[0, np.cumsum(np.repeat(size > LONG, size))]
    ok &= (end <= stop) & (long[end] > long[at])
    return at[ok], end[ok]


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence's part that has one, the shortest run from it with RUN parts and WORDS words, and those of cut_runs: document, first word in it, number of words, hash."""
    _, unit, head, first, words = sentences(data, offs)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    n = len(unit) - 1
    i = np.arange(n)
    j = np.maximum(i + RUN, np.searchsorted(unit, unit[:-1] + WORDS, "left"))
    ok = j <= n
    i, j = i[ok], j[ok]
    a, b, c = unit[i], unit[j], (j - i).astype(U)
    ok = b <= first[np.searchsorted(first, a, "right")]
    a, b, c = a[ok], b[ok], c[ok]
    x, y = cut_runs(head, first, words)
    a, b, c = np.r_[a, x], np.r_[b, y], np.r_[c, np.zeros(len(x), U)]
    doc = np.searchsorted(first, a, "right") - 1
    up, down = K.powers(len(words) + 1)
    total = np.r_[U(0), np.cumsum(words * up[: len(words)])]
    return doc, a - first[doc], b - a, K.mix((total[b] - total[a]) * down[a] + c)


def run_rows(batches):
    """Arrow function: (id, th, text) to rows (h, id, th, at, n, again). In a batch only the first place of a run is compared with others; later ones are again for sure, and get a hash of their own."""
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0).to_numpy()
        th = batch.column(1).to_numpy()
        data, offs = text_bytes(batch.column(2))
        cols = [[] for _ in range(4)]
        for i, j in doc_chunks(offs):
            doc, at, n, h = runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            for c, x in zip(cols, (doc + i, at, n, h)):
                c.append(x)
        doc, at, n, h = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        h = h.astype(U)
        order = np.lexsort((at, th[doc], ids[doc], h))
        doc, at, n, h = doc[order], at[order], n[order], h[order]
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & ~((ids[doc][1:] == ids[doc][:-1]) & (th[doc][1:] == th[doc][:-1]) & (at[1:] == at[:-1]))
        copy = np.zeros(len(h), bool)  # the same place of a repeated row
        copy[1:] = (h[1:] == h[:-1]) & ~same[1:]
        lead = np.maximum.accumulate(np.where((h != np.r_[h[:1] + U(1), h[:-1]]) if len(h) else same, np.arange(len(h)), 0))
        first = (ids[doc] == ids[doc][lead]) & (th[doc] == th[doc][lead]) & (at == at[lead]) if len(h) else same
        again = ~first
        key = np.where(again, K.mix(h + ids[doc].astype(U) + at.astype(U)), h).view(np.int64) if len(h) else np.zeros(0, np.int64)
        keep = np.flatnonzero(~copy)
        keep = keep[np.lexsort((at[keep], doc[keep]))]  # a document's rows together, which its id and hash compress well in
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(ids[doc][keep]), pa.array(th[doc][keep]), pa.array(at[keep], pa.int32()), pa.array(n[keep], pa.int32()), pa.array(again[keep])], ["h", "id", "th", "at", "n", "again"])


def later(batches):
    """Arrow function over rows sorted by again, h, id, th and at: (id, th, at, n) of all but the first place of each run. Holds one place."""
    import pyarrow as pa

    place = None
    for batch in batches:
        h, ids, th, at, n, again = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        at0, id0, th0 = at[lead], ids[lead], th[lead]
        if place is not None and place[0] == h[0]:
            head = lead == 0
            id0, th0, at0 = np.where(head, place[1], id0), np.where(head, place[2], th0), np.where(head, place[3], at0)
        plain = np.flatnonzero(~again)
        if len(plain):
            k = plain[-1]
            place = (h[k], id0[k], th0[k], at0[k])
        keep = again | ~((ids == id0) & (th == th0) & (at == at0))
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(th[keep]), pa.array(at[keep]), pa.array(n[keep])], ["id", "th", "at", "n"])


def cut(batches):
    """Arrow function: (id, text, list of (at, n)) to (id, n_sentences, n_removed, spans, kept)."""
    import pyarrow as pa

    for batch in batches:
        data, offs = text_bytes(batch.column(1))
        count, removed, spans, kept = [], [], [], []
        found = batch.column(2)
        till = np.r_[0, np.cumsum(found.value_lengths().fill_null(0).to_numpy())]
        at_, n_ = (x.to_numpy() for x in found.flatten().flatten())
        for i in range(len(offs) - 1):
            x = data[offs[i] : offs[i + 1]]
            start, unit, _, _, _ = sentences(x, np.array([0, len(x)]))
            f = slice(till[i], till[i + 1])
            size = len(start) + 1
            gone = np.cumsum(np.bincount(at_[f], minlength=size) - np.bincount(at_[f] + n_[f], minlength=size))[:-1] > 0
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            bounds = np.r_[start, len(x)]
            ab = bounds[edge].reshape(-1, 2)
            stays = np.r_[0, np.cumsum(~gone)]
            raw, out, at = x.tobytes(), [], 0
            for a, b in ab.tolist():
                out.append(raw[at:a])
                at = b
            out.append(raw[at:])
            count.append(len(unit) - 1)
            removed.append(int((stays[unit[1:]] == stays[unit[:-1]]).sum()))
            spans.append([{"start": int(a), "end": int(b)} for a, b in ab])
            kept.append(b"".join(out).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], ["id", "n_sentences", "n_removed", "spans", "kept"])


def remove_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes sentences, and parts of long ones, that a repeated run covers, but for the run's first place by id, text and position.

    Returns a row for each row of docs: id, n_sentences, n_removed (those that
    went as a whole), spans (start and end of the removed stretches in bytes, end
    exclusive), kept (text). Words are runs of anything but ASCII white space,
    A-Z lower-cased; a stretch reaches up to the next word. A null id comes before all
    others; ids that aren't whole numbers come in the order of a hash. Null and empty texts have no sentences; the kept text is then empty.
    Rows with one id and text are one document, so they don't remove each other.
    Of equal ids with different texts, the order is that of a hash. An empty table
    gives no rows. Other columns are not read. Exact for 64-bit hashes. Texts are taken whole, however long.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "sentences")
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    key = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(key, F.lit(-(1 << 63))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text", F.col("id").isNull()))
    rows = docs.select("key", "th", "text").mapInArrow(run_rows, "h long, id long, th long, at int, n int, again boolean")
    rows = rows.repartition("h").sortWithinPartitions("again", "h", "id", "th", "at")
    gone = rows.mapInArrow(later, "id long, th long, at int, n int").groupBy("id", "th").agg(F.collect_set(F.struct("at", "n")).alias("found"))
    gone = scratch.table(gone.withColumnRenamed("id", "key"))
    kind = docs.schema["id"].dataType.simpleString()
    out = docs.join(gone, ["key", "th"], "left").select("id", "text", "found").mapInArrow(cut, f"id {kind}, n_sentences long, n_removed long, spans array<struct<start:long,end:long>>, kept string")
    return out.withColumnRenamed("id", id_col)
