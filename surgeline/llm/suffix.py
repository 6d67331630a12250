"""Suffix-array dedup: bytes of strings of LENGTH that also start elsewhere, by a Burrows-Wheeler transform.

Of the GRAM-byte hashes in a window of LENGTH bytes, the least is its anchor;
equal windows have equal anchors at the same place. Windows are dealt out by
anchor, each with the stretch of text that its neighbours of the same anchor
cover, and only anchors that stand at two places go on. A task builds the
Burrows-Wheeler transform of its stretches and derives common prefixes by
increasing value: intervals of suffixes are extended backward, breadth first, and
a boundary that is first met at some length gets it as its common prefix. It stops
at LENGTH; boundaries that are left have longer common prefixes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgeline.llm import kernels as K
from surgeline.llm.shared import Scratch, text_bytes, tune

U = np.uint64
LENGTH, GRAM = 200, 32
#: Bytes of one transform; an anchor whose stretches are longer is dealt out window by window.
BLOCK = 2 << 20
#: Bytes of a document that are hashed at a time (positions take 24 bits).
PIECE = 1 << 22


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with the same anchor: the anchor's hash, a hash of the stretch, its start and its length."""
    found = []
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        x = data[at : at + PIECE + length - 1]
        if len(x) < length:
            continue
        prefix = K.prefix_hash(x)
        n, width = len(x) - gram + 1, length - gram + 1
        h = K.span_hash(prefix, np.arange(n), np.arange(gram, n + gram))
        least = (h & ~U((1 << 24) - 1)) | np.arange(n, dtype=U)
        step = 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if width > step:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        size = np.diff(np.r_[start, len(least)]) + length - 1
        found.append((h[(least[start] & U((1 << 24) - 1)).astype(np.int64)], K.span_hash(prefix, start, start + size), start + at, size))
    if not found:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def suffix_order(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cyclic text x in the order of their first depth bytes or more, and how many of 8 bytes each shares with the one before."""
    n = len(x)
    wide = np.concatenate([x, x[np.arange(8) % n]]).astype(U)
    key = np.zeros(n, U)
    for j in range(8):
        key |= wide[j : j + n] << U(56 - 8 * j)
    order = np.argsort(key)
    key = key[order]
    differ = key[1:] ^ key[:-1]
    common = np.zeros(n, np.int64)
    for j in range(1, 9):
        common[1:] += (differ >> U(64 - 8 * j)) == 0
    head = np.r_[True, differ != 0]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    length = 8
    while length < depth:
        many = ~head
        many[:-1] |= ~head[1:]
        slots = np.flatnonzero(many)
        if not len(slots):
            break
        pos = order[slots]
        sub = (rank[pos] << 32) | rank[(pos + length) % n]
        by = np.argsort(sub)
        sub = sub[by]
        order[slots] = pos[by]
        new = np.r_[True, sub[1:] != sub[:-1]]
        head[slots] = new
        rank[pos[by]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        length *= 2
    return order, common


def long_prefixes(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the cyclic text x, and for each place in it (and one more) whether it shares length bytes with the one before."""
    n = len(x)
    order, common = suffix_order(x, length + 1)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = place[order - 1]  # the row of the suffix that is one byte longer: the last-to-first mapping
    first = x[order]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    unset[:n] &= common >= 8
    depth = 8
    ends = np.r_[common, 7]
    hi = np.flatnonzero(ends[1:] == 7) + 1
    starts = np.flatnonzero(common < 8)
    lo = starts[np.searchsorted(starts, hi, "left") - 1]
    while depth < length and len(lo):
        one = hi - lo == 1
        single = back[lo[one]]
        lo, size = lo[~one], (hi - lo)[~one]
        owner = np.repeat(np.arange(len(lo)), size)
        rows = back[np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(owner))] if len(lo) else np.zeros(0, np.int64)
        key = np.sort((owner << 32) | rows)
        rows = key & 0xFFFFFFFF
        cut = np.ones(len(key), bool)
        cut[1:] = (key[1:] != key[:-1] + 1) | (first[rows[1:]] != first[rows[:-1]])
        begin = np.flatnonzero(cut)
        lo = np.concatenate([single, rows[begin]])
        hi = np.concatenate([single + 1, rows[np.r_[begin[1:] - 1, len(rows) - 1]] + 1]) if len(rows) else single + 1
        fresh = unset[hi]
        unset[hi[fresh]] = False  # the common prefix here is depth
        lo, hi = lo[fresh], hi[fresh]
        depth += 1
    return order, unset


def repeated(segments: list[bytes], many: list[bool], length: int) -> list[list[int]]:
    """For each segment the starts and ends (exclusive) of runs of window starts whose window stands twice or more. many: the segment itself does."""
    sizes = np.array([len(s) for s in segments])
    x = np.frombuffer(b"\xff".join([*segments, b""]), np.uint8)
    at = np.r_[0, np.cumsum(sizes + 1)]
    order, same = long_prefixes(x, length)
    hit = np.empty(len(x), bool)
    hit[order] = same[:-1] | same[1:]
    inside = np.zeros(len(x) + 1, np.int64)
    valid = np.maximum(sizes - length + 1, 0)
    np.add.at(inside, at[:-1], 1)
    np.add.at(inside, at[:-1] + valid, -1)
    hit |= np.repeat(np.asarray(many, bool), sizes + 1)
    hit &= np.cumsum(inside[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    owner = np.searchsorted(at, edge[::2], "right") - 1
    runs = (edge.reshape(-1, 2) - at[owner][:, None]) if len(edge) else np.zeros((0, 2), np.int64)
    where = np.searchsorted(owner, np.arange(len(segments) + 1))
    return [runs[a:b].ravel().tolist() for a, b in zip(where[:-1], where[1:])]


def stretches(length: int, gram: int):
    """Arrow function: (text hash, text) to rows (h, seg, th, start, size, copies, sure). Equal texts in a batch are one row each with their number.

    Of a stretch that stands more than once in a batch, one row stands for all; the
    others are sure to be repeated, so they go anywhere and no anchor gathers them.
    """
    import pyarrow as pa

    names = ["h", "seg", "th", "start", "size", "copies", "sure"]

    def run(batches):
        for batch in batches:
            th = batch.column(0).to_numpy()
            data, offs = text_bytes(batch.column(1))
            _, first, copies = np.unique(th, return_index=True, return_counts=True)
            parts = []
            for i, c in zip(first.tolist(), copies.tolist()):
                h, seg, start, size = anchors(data[offs[i] : offs[i + 1]], length, gram)
                if len(h):
                    parts.append((h.view(np.int64), seg.view(np.int64), np.full(len(h), th[i]), start, size, np.full(len(h), c)))
            if parts:
                h, seg, place, start, size, copies = (np.concatenate(c) for c in zip(*parts))
                order = np.lexsort((seg, h))
                new = np.ones(len(h), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (seg[order][1:] != seg[order][:-1])
                total = np.add.reduceat(copies[order], np.flatnonzero(new))
                copies[order[new]] = total
                sure = np.zeros(len(h), bool)
                sure[order[~new]] = True
                copies[sure] = 2
                h[sure] = K.mix((seg[sure] ^ place[sure]).view(U) + start[sure].astype(U)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (h, seg, place, start, size, copies)], pa.array(sure)], names)

    return run


def shared_anchors(batches):
    """Arrow function over rows sorted by h, seg, th and start: keeps rows of anchors at two places or more; lead marks the first row of each stretch, many a stretch that stands twice. Holds one row back."""
    import pyarrow as pa

    names = ["h", "seg", "th", "start", "size", "many", "lead"]
    held = None

    def table(c, n):
        h, seg, copies = c[0], c[1], c[5]
        lead = np.ones(n, bool)
        lead[1:] = (seg[1:] != seg[:-1]) | (h[1:] != h[:-1])
        return h, seg, copies, lead & ~c[6]

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        if not len(cols[0]):
            continue
        before = held
        if held is not None:
            cols = [np.r_[a, b] for a, b in zip(held["row"], cols)]
        n = len(cols[0])
        h, seg, copies, lead = table(cols, n)
        same_h = np.zeros(n + 1, bool)
        same_h[1:n] = h[1:] == h[:-1]
        keep = same_h[:-1] | same_h[1:] | (copies > 1)
        twice = copies > 1
        twice[:-1] |= ~lead[1:] & ~cols[6][1:]
        twice[1:] |= ~lead[1:] & ~cols[6][1:]
        if before is not None:
            keep[0] |= before["keep"]
            twice[0] |= before["twice"]
            lead[0] = before["lead"]
        last = n - 1
        held = {"row": [c[last:] for c in cols], "keep": bool(keep[last]), "twice": bool(twice[last]), "lead": bool(lead[last])}
        out = np.flatnonzero(keep[:last])
        yield pa.RecordBatch.from_arrays([*[pa.array(c[out]) for c in cols[:5]], pa.array(twice[out]), pa.array(lead[out])], names)
    if held is not None and held["keep"]:
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in held["row"][:5]], pa.array([held["twice"]]), pa.array([held["lead"]])], names)


def of_first_copies(cut):
    """Arrow function: (th, text, cuts) to what cut makes of (text, cuts). All copies of a text have the same stretches to give, so a task takes those of the first."""
    import pyarrow as pa

    def rest(batches):
        done = set()
        for batch in batches:
            new = [i for i, th in enumerate(batch.column(0).to_pylist()) if not (th in done or done.add(th))]
            yield batch.take(pa.array(new, pa.int64())).select([1, 2])

    return lambda batches: cut(rest(batches))


def cut_out(length: int):
    """Arrow function: (text, list of (h, seg, start, size, many, wide)) to rows (block, seg, off, part, many, wide).

    A stretch of a wide anchor goes window by window. Of a window that stands more
    than once in a batch, one row stands for all in its block; the others are sure to
    be repeated, so they go anywhere.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            cols = block, seg, off, part, many, wide = [], [], [], [], [], []
            first: dict[int, int] = {}  # the row that stands for a window
            for text, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                for c in cuts:
                    s = raw[c["start"] : c["start"] + c["size"]]
                    rows = [(c["h"], 0, s, c["many"])]
                    if c["wide"]:
                        P = K.prefix_hash(np.frombuffer(s, np.uint8))
                        k = np.arange(len(s) - length + 1)
                        rows = ((b, i, s[i : i + length], c["many"]) for i, b in enumerate(K.span_hash(P, k, k + length).view(np.int64).tolist()))
                    for b, i, x, sure in rows:
                        if c["wide"]:
                            at = first.setdefault(b, len(block))
                            if at < len(block) and part[at] == x:
                                many[at] = sure = True
                                b = hash((c["seg"], i))
                        for col, value in zip(cols, (b, c["seg"], i, x, sure, c["wide"])):
                            col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(seg, pa.int64()), pa.array(off, pa.int64()), pa.array(part, pa.binary()), pa.array(many, pa.bool_()), pa.array(wide, pa.bool_())], ["block", "seg", "off", "part", "many", "wide"])

    return run


def transform_blocks(length: int, limit: int):
    """Arrow function over rows (block, seg, off, part, many, wide) sorted by block, seg and off: (seg, runs).

    Whole blocks share a transform, up to limit bytes. A block of windows, which are all
    alike, may go on in the next transform, where the one before its first row stands for what came before.
    """
    import pyarrow as pa

    def run(batches):
        segs, offs, parts, many, size, key, last = [], [], [], [], 0, None, False

        def close():
            runs = repeated(parts, many, length)
            return pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array([[x + o for x in r] for r, o in zip(runs, offs)], pa.list_(pa.int32()))], ["seg", "runs"])

        for batch in batches:
            for b, s, o, p, m, w in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if size >= limit and (b != key or (last and w)):
                    yield close()
                    kept = slice(-1 if b == key else len(segs), None)
                    segs, offs, parts, many = segs[kept], offs[kept], parts[kept], many[kept]
                    size = sum(map(len, parts))
                if b == key and segs and segs[-1] == s and offs[-1] == o:
                    continue  # another copy of the text that it was cut from
                key, last = b, w
                segs.append(s)
                offs.append(o)
                parts.append(p)
                many.append(m)
                size += len(p)
        if segs:
            yield close()

    return run


def strip(length: int):
    """Arrow function: (id, text, list of (start, runs)) to (id, n_bytes, n_removed, spans, kept)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            size, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode()
                ends = sorted((f["start"] + f["runs"][k], f["start"] + f["runs"][k + 1] - 1 + length) for f in found or () for k in range(0, len(f["runs"]), 2))
                merged: list[list[int]] = []
                for a, b in ends:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                out, at = [], 0
                for a, b in merged:
                    out.append(raw[at:a])
                    at = b
                out.append(raw[at:])
                kept.append(b"".join(out))
                size.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                spans.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each byte that a string of length bytes covers which also starts anywhere else, the same document included.

    Returns a row for each row of docs: id, n_bytes, n_removed, spans (start and
    end of the maximal removed runs, in bytes, end exclusive), kept (the bytes
    that stay; cuts may fall inside a character). Matches never cross documents,
    overlaps count, and strings are judged on the input. Null texts are empty.
    Texts shorter than length keep all. Repeated rows are places of their own, so
    they lose every byte of long enough texts. An empty table gives no rows.
    Other columns are not read. Exact for 64-bit hashes of anchors and stretches:
    strings of a transform are compared byte by byte.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "suffix")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    kind = docs.schema["id"].dataType.simpleString()
    long = docs.where(F.octet_length("text") >= length)
    rows = long.select("th", "text").mapInArrow(stretches(length, gram), "h long, seg long, th long, start long, size long, copies long, sure boolean")
    rows = rows.repartition("h").sortWithinPartitions("h", "seg", "th", "start")
    places = scratch.table(rows.mapInArrow(shared_anchors, "h long, seg long, th long, start long, size long, many boolean, lead boolean"))
    # a stretch's mark for standing twice is complete on its first row
    leads = places.where("lead").select("h", "seg", "th", "start", "size", "many")
    wide = leads.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 4 * BLOCK).select("h", F.lit(True).alias("wide"))
    leads = leads.join(wide, "h", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    cuts = leads.groupBy("th").agg(F.collect_list(F.struct("h", "seg", "start", "size", "many", "wide")).alias("cuts"))
    parts = long.select("th", "text").join(cuts, "th").select("th", "text", "cuts").mapInArrow(of_first_copies(cut_out(length)), "block long, seg long, off long, part binary, many boolean, wide boolean")
    parts = parts.repartition("block").sortWithinPartitions("block", "seg", "off")
    runs = parts.mapInArrow(transform_blocks(length, BLOCK), "seg long, runs array<int>").where(F.size("runs") > 0)
    runs = scratch.table(runs)
    found = places.select("seg", "th", "start").join(runs, "seg").groupBy("th").agg(F.collect_set(F.struct("start", "runs")).alias("found"))
    out = docs.join(found, "th", "left").select("id", "text", "found").mapInArrow(strip(length), f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
