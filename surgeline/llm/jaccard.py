"""N-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row for each distinct shingle set and a column for each
shingle. In an order of all shingles that puts crowded ones last, a row keeps its
first entries alone: as many as may differ from a partner, by the sizes, and NEED
more. Two linked rows share NEED of the entries that both keep, so the product of
these short rows, with overlap counts accumulated over the columns, has every link;
pairs whose counts stay below what their sizes ask for are discarded. What is left
forms candidate blocks, whose whole rows are multiplied, rarest columns first.
Exact for 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgeline.llm import kernels as K
from surgeline.llm.graph import connected_components
from surgeline.llm.shared import Scratch, doc_chunks, maybe_broadcast, text_bytes, tune

U = np.uint64
#: Shingles that one task holds at a time; larger blocks are dealt out in parts.
BLOCK = 4_000_000
#: Sets that share a column up to which all their pairs are counted.
TOGETHER = 32
#: Cells in which shingles are counted over all texts, and slices of that table. The counts only put
#: shingles in order: any order gives the same links.
CELLS, SLICES = 1 << 21, 32


def need_of(n, num: int, den: int):
    """Entries that a row of n must share with a partner among those that both keep: half of what may differ."""
    return np.maximum(1, n * (den - num) // (2 * den))


def kept_of(n, num: int, den: int):
    """Entries that a row of n keeps: those that a linked row may lack, and need_of more."""
    return n + n * num // -den + need_of(n, num, den)


def _signed(x) -> np.ndarray:
    return np.asarray(x, U).view(np.int64)


def _node(s: np.ndarray) -> np.uint64:
    return K.mix(np.add.reduce(K.mix(s ^ U(0x5851F42D4C957F2D)), keepdims=True) + U(len(s)))[0]


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> U(64 - CELLS.bit_length() + 1)).astype(np.int64)


def sets_of(batch_column, words: int):
    """(position, shingle set) of each text of an Arrow column."""
    data, offs = text_bytes(batch_column)
    for i, j in doc_chunks(offs):
        yield from enumerate(K.shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words), i)


def cell_counts(words: int):
    """Arrow function: texts to (slice, salt, counts) of the cells of a task's shingle sets. Equal sets of a batch count once."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        counts = np.zeros(CELLS, "<u8")
        for batch in batches:
            seen, found = set(), []
            for _, s in sets_of(batch.column(0), words):
                if len(s) and (node := int(_node(s))) not in seen:
                    seen.add(node)
                    found.append(_cells(s))
            if found:
                cells, times = np.unique(np.concatenate(found), return_counts=True)
                counts[cells] += times.astype("<u8")
        rows = [x.tobytes() for x in counts.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId() % 256] * SLICES, pa.int32()), pa.array(rows, pa.binary())], ["slice", "salt", "counts"])

    return run


def add_up(together: int | None = None):
    """Arrow function over (slice, salt, counts) sorted by slice: the sums of each slice; given together, bits in their place, of the cells with more than that and six deviations above a cell's mean. Holds one slice."""
    import pyarrow as pa

    def run(batches):
        key, salt, total = None, 0, None

        def close():
            out = total if together is None else np.packbits(total > max(together, total.mean() + 6 * np.sqrt(total.mean()) + 2))
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([salt], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["slice", "salt", "counts"])

        for batch in batches:
            for k, t, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and k != key:
                    yield close()
                    total = None
                key, salt = k, t
                total = np.frombuffer(counts, "<u8") + (0 if total is None else total)
        if key is not None:
            yield close()

    return run


def crowded_cells(docs: DataFrame, words: int) -> np.ndarray:
    """A bit for each of the CELLS: whether its shingles are crowded."""
    kind = "slice int, salt int, counts binary"
    counts = docs.select("text").mapInArrow(cell_counts(words), kind)
    counts = counts.repartition("slice", "salt").sortWithinPartitions("slice", "salt").mapInArrow(add_up(), kind)
    counts = counts.repartition("slice").sortWithinPartitions("slice").mapInArrow(add_up(TOGETHER), kind)
    bits = {r["slice"]: np.frombuffer(r["counts"], np.uint8) for r in counts.collect()}  # SLICES rows
    return np.concatenate([bits.get(k, np.zeros(CELLS // SLICES // 8, np.uint8)) for k in range(SLICES)])


def kept_rows(words: int, num: int, den: int, crowded: np.ndarray, together: int):
    """Arrow function: (id, th, text) to (id, th, n, node, sigs, crowds, hubs).

    A set's kept entries are its sigs; equal sets of a batch list them once. An entry
    that more than together sets of a batch keep is in hubs instead, and the first of
    these sets has it in crowds too. crowded: bits of crowded_cells.
    """
    import pyarrow as pa

    def run(batches):
        last = np.unpackbits(crowded).view(bool)
        for batch in batches:
            n = len(batch)
            size, node, sigs = np.zeros(n, np.int64), np.zeros(n, U), [np.zeros(0, U)] * n
            seen: set[int] = set()
            for k, s in sets_of(batch.column(2), words):
                if size_k := len(s):
                    size[k], node[k] = size_k, _node(s)
                    if (key := int(node[k])) not in seen:
                        seen.add(key)
                        many = last[_cells(s)]
                        keep = int(kept_of(size_k, num, den))
                        first = s[~many][:keep]
                        sigs[k] = np.concatenate([first, s[many][: keep - len(first)]])
            flat, owner = (np.concatenate(sigs) if n else np.zeros(0, U)), np.repeat(np.arange(n), [len(x) for x in sigs])
            order = np.argsort(flat, kind="stable")
            new = np.ones(len(flat), bool)
            new[1:] = flat[order][1:] != flat[order][:-1]
            at = np.flatnonzero(new)
            group = np.diff(np.r_[at, len(flat)])
            large = np.repeat(group > together, group)
            lone, crowd, hub = np.sort(order[~large]), np.sort(order[large & new]), np.sort(order[large])
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[x], np.arange(n + 1)), pa.int32()), pa.array(_signed(flat[x])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(size), pa.array(_signed(node)),
                    lists(lone), lists(crowd), lists(hub),
                ],
                ["id", "th", "n", "node", "sigs", "crowds", "hubs"],
            )

    return run


def pairs(together: int):
    """Arrow function over rows (sig, crowd, node) sorted by sig, crowds first, and node: (a, b, large).

    All pairs of a column that up to together sets keep; of larger columns, and of
    crowds, each set and the column itself. Holds a batch and a group of up to four
    times together.
    """
    import pyarrow as pa

    def run(batches):
        sig, crowd, node = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        first = None  # the column of a large group that goes on

        def rows(a, b, large):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(large, bool))], ["a", "b", "large"])

        def close(sig, crowd, node):
            new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])][: len(sig)]
            sig, crowd, node = sig[new], crowd[new], node[new]
            at = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
            size = np.diff(np.r_[at, len(sig)])
            star = crowd[at] | (size > together)
            a, b, large = [], [], []
            for g in np.unique(size[(size > 1) & ~star]).tolist():
                them = at[(size == g) & ~star][:, None] + np.arange(g)
                i, j = np.triu_indices(g, 1)
                a.append(node[them[:, j]].ravel())
                b.append(node[them[:, i]].ravel())
                large.append(np.zeros(len(a[-1]), bool))
            inside = np.repeat(star, size)
            a.append(node[inside])
            b.append(sig[inside])
            large.append(np.ones(len(a[-1]), bool))
            return rows(*map(np.concatenate, (a, b, large)))

        for batch in batches:
            s, c, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if first is not None:
                mine = s == first
                if mine.any():
                    yield rows(v[mine], s[mine], np.ones(mine.sum(), bool))
                if not mine.all():
                    first = None
                s, c, v = s[~mine], c[~mine], v[~mine]
            sig, crowd, node = np.r_[sig, s], np.r_[crowd, c], np.r_[node, v]
            if not len(sig):
                continue
            cut = int(np.searchsorted(sig, sig[-1], "left"))
            yield close(sig[:cut], crowd[:cut], node[:cut])
            sig, crowd, node = sig[cut:], crowd[cut:], node[cut:]
            if len(sig) > 4 * together and (crowd[0] or len(np.unique(node)) > together):
                yield close(sig, crowd, node)
                first = sig[0]
                sig, crowd, node = sig[:0], crowd[:0], node[:0]
        if len(sig):
            yield close(sig, crowd, node)

    return run


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Component of each set (the position of one of its members) under links of num / den.

    Columns are renumbered by how many sets have them, rarest first; each set's
    prefix lists what two linked sets must share one of. A list whose sets are
    all joined already is done; of the others, only sets outside the list's
    largest component count their overlaps with the rest.
    """
    n = len(sets)
    label = np.arange(n)
    lens = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, U)
    _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    col, owner = rank[col], np.repeat(np.arange(n), lens)
    df = np.sort(df)
    order = np.lexsort((col, owner))
    col = col[order]
    ptr = np.concatenate(([0], np.cumsum(lens)))
    keep = np.arange(len(col)) - ptr[owner] < (lens - -(-lens * num // den) + 1)[owner]
    keep &= df[col] > 1
    pcol, pdoc = col[keep], owner[keep]
    order = np.argsort(pcol, kind="stable")
    pcol, pdoc = pcol[order], pdoc[order]
    at = np.flatnonzero(np.r_[True, pcol[1:] != pcol[:-1]]) if len(pcol) else np.zeros(0, np.int64)
    end = np.r_[at[1:], len(pcol)]
    of_doc = np.argsort(pdoc, kind="stable")
    doc_at = np.searchsorted(pdoc[of_doc], np.arange(n + 1))
    list_of = np.repeat(np.arange(len(at)), end - at)
    mark = np.zeros(len(df), bool)
    done = np.zeros(n, bool)

    def open_lists() -> np.ndarray:
        if not len(at):
            return at
        x = label[pdoc]
        return np.flatnonzero(np.minimum.reduceat(x, at) != np.maximum.reduceat(x, at))

    def count(i: int, is_open: np.ndarray) -> None:
        done[i] = True
        lists = list_of[of_doc[doc_at[i] : doc_at[i + 1]]]
        lists = lists[is_open[lists]]
        if not len(lists):
            return
        c = np.unique(np.concatenate([pdoc[at[k] : end[k]] for k in lists.tolist()]))
        c = c[(label[c] != label[i]) & (np.minimum(lens[c], lens[i]) * den >= num * np.maximum(lens[c], lens[i]))]
        if not len(c):
            return
        mark[col[ptr[i] : ptr[i + 1]]] = True
        ls = lens[c]
        starts = np.cumsum(ls) - ls
        both = np.add.reduceat(mark[col[np.repeat(ptr[c] - starts, ls) + np.arange(ls.sum())]].astype(np.int64), starts)
        mark[col[ptr[i] : ptr[i + 1]]] = False
        for k in np.unique(label[c[den * both >= num * (ls + lens[i] - both)]]).tolist():
            label[label == k] = label[i]

    rounds = 0
    while len(still := open_lists()):
        is_open = np.zeros(len(at), bool)
        is_open[still] = True
        rows = set()
        for k in still.tolist():
            docs = pdoc[at[k] : end[k]]
            names, inverse, counts = np.unique(label[docs], return_inverse=True, return_counts=True)
            others = docs[inverse != counts.argmax()]
            rows.update(others.tolist() if rounds >= 3 else (int(others[0]), int(docs[inverse == counts.argmax()][0])))
        todo = [i for i in sorted(rows) if not done[i]]
        if not todo and rounds >= 3:
            break
        for i in todo:
            count(i, is_open)
        rounds += 1
    return label


def once(batches):
    """Arrow function over (node, text): each node's first row in the task. Holds the task's nodes."""
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for i, node in enumerate(batch.column(0).to_pylist()):
            if node not in seen:
                seen.add(node)
                keep.append(i)
        yield batch.take(keep) if len(keep) < len(batch) else batch


def block_links(words: int, num: int, den: int):
    """Arrow function over rows (block, part, node, text) sorted by block and part: edges (a, b) that join each block's linked nodes."""
    import pyarrow as pa

    def run(batches):
        key, nodes, sets, seen = None, [], [], set()

        def close():
            label = linked(sets, num, den)
            name = np.array(nodes, np.int64)
            least = np.full(len(name), np.iinfo(np.int64).max)
            np.minimum.at(least, label, name)
            keep = least[label] != name
            return pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(least[label][keep])], ["a", "b"])

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            names = batch.column(2).to_pylist()
            for k, s in sets_of(batch.column(3), words):
                if keys[k] != key:
                    if len(nodes) > 1:
                        yield close()
                    key, nodes, sets, seen = keys[k], [], [], set()
                if names[k] not in seen:
                    seen.add(names[k])
                    nodes.append(names[k])
                    sets.append(s)
        if len(nodes) > 1:
            yield close()

    return run


def candidates(rows: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between nodes, over which any two linked ones are connected."""
    listed = rows.select(F.explode("sigs").alias("sig"), F.lit(False).alias("crowd"), "node").union(rows.select(F.explode("crowds").alias("sig"), F.lit(True), "node"))
    listed = listed.repartition("sig").sortWithinPartitions("sig", F.desc("crowd"), "node")
    met = listed.mapInArrow(pairs(TOGETHER), "a long, b long, large boolean").groupBy("a", "b", "large").agg(F.count("*").alias("c"))
    met = scratch.table(met)
    sizes = maybe_broadcast(scratch.table(rows.where("n > 0").groupBy("node").agg(F.max("n").alias("n"))), 500_000)
    need = lambda n: F.greatest(F.lit(1), F.floor(n * (den - num) / (2 * den)))
    small = met.where("not large").join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    small = scratch.table(small.where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num)).select("a", "b", "c", need(F.least("na", "nb")).alias("need")))
    # a set's entries in large columns matter only if they could make up what its counted pairs lack
    large = scratch.table(met.where("large").select("a", "b").union(rows.select("node", F.explode("hubs"))).distinct())
    most = small.select(F.col("a").alias("node"), "c").union(small.select("b", "c")).groupBy("node").agg(F.max("c").alias("most"))
    wide = large.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("wide")).join(most, "node", "left").join(sizes, "node")
    wide = scratch.table(wide.where(F.col("wide") + F.coalesce("most", F.lit(0)) >= need(F.ceil(F.col("n") * num / den))).select(F.col("node").alias("a"), "n"))
    # partners are of the same or the next band of sizes (wider than need be, as logarithms are rounded), so they meet in a column's part for a band
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.001 * float(np.log(den / num))))
    columns = large.join(maybe_broadcast(wide, 500_000), "a").select("a", F.explode(F.array(band, band + 1)).alias("band"), "b")
    columns = scratch.table(columns.select("a", F.xxhash64("b", "band").alias("k")))
    first = scratch.table(columns.groupBy("k").agg(F.min("a").alias("b")))
    return scratch.table(small.where("c >= need").select("a", "b").union(columns.join(first, "k").where("a <> b").select("a", "b").distinct()))


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links of word-shingle sets by Jaccard similarity of at least num / den, as one row for each document.

    Returns (doc_id, n_shingles, component_id): the size of the set, and the
    smallest id among the documents reachable by links. Words are runs of
    anything but ASCII white space, A-Z lower-cased.
    Null or empty texts: 0 shingles, linked with nothing. Fewer words than a
    shingle: the whole sequence is the one shingle. Repeated rows stay, with
    equal results. A document with a null id links others like any other, but its id
    counts in no minimum; a component of such documents alone has a null id. An
    empty table gives an empty result. Other columns are not read. Ties don't arise:
    links are exact. Texts are taken whole, however long.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    crowded = crowded_cells(docs, words)
    rows = scratch.table(docs.mapInArrow(kept_rows(words, num, den, crowded, TOGETHER), f"id {kind}, th long, n long, node long, sigs array<long>, crowds array<long>, hubs array<long>"))
    inner = Scratch(spark, "jaccard-blocks")  # of tables that the result doesn't read
    edges = candidates(rows, num, den, inner)
    blocks = connected_components(edges, inner)
    # one document stands for each set; large blocks are dealt out in parts
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep")
    owners = inner.table(rows.where("n > 0").groupBy("node").agg(rep, F.first("n").alias("n")).join(blocks, "node"))
    parts = owners.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    members = owners.join(parts, "root").select("node", "root", "n", "parts", F.pmod(F.hash("node"), F.col("parts")).alias("part"))
    members = inner.table(members)
    who = maybe_broadcast(owners.select("node", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth")), 500_000)
    texts = docs.join(who, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).select("node", "text")
    texts = inner.table(texts.mapInArrow(once, "node long, text string"))

    def within(df: DataFrame) -> DataFrame:
        df = df.join(texts, "node").repartition("block", "part").sortWithinPartitions("block", "part")
        return df.select("block", "part", "node", "text").mapInArrow(block_links(words, num, den), "a long, b long")

    # part 0 meets every part
    meets = F.when(F.col("part") == 0, F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0)))).otherwise(F.array("part"))
    links = inner.table(within(members.select("node", F.col("root").alias("block"), F.explode(meets).alias("part"))))
    roots = connected_components(links, inner)
    large = members.where("parts > 1")
    if large.limit(1).count():
        # any link that is still missing has an end outside the largest component of its block; such ends meet every part
        group = large.withColumnRenamed("root", "block").join(roots, "node", "left").withColumn("now", F.coalesce("root", "node"))
        sizes = group.groupBy("block", "now").agg(F.count("*").alias("c"))
        most = sizes.groupBy("block").agg(F.max_by("now", F.struct("c", "now")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
        group = group.join(most, "block").withColumn("minor", F.col("now") != F.col("most"))
        minor = group.where("minor").groupBy("block").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("minors"))
        group = group.join(minor, "block")
        cells = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda x: x * F.col("parts") + F.col("part"))
        own = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda y: F.pmod(F.hash("node", F.lit(1)), F.col("minors")) * F.col("parts") + y)
        group = group.withColumn("cells", F.when(F.col("minor"), F.array_distinct(F.concat(cells, own))).otherwise(cells))
        roots = connected_components(links.union(within(group.select("node", "block", F.explode("cells").alias("part")))), inner)
    # the least id of each component goes to its sets, and from there to the rows; sets of one row and no link need none
    least = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("many")).join(roots, "node", "left").where("many > 1 or root is not null")
    least = inner.table(least.select("node", F.coalesce("root", "node").alias("root"), "least"))
    lowest = inner.table(least.groupBy("root").agg(F.min("least").alias("lowest")))
    least = scratch.table(least.select("node", "root").join(lowest, "root").select(F.col("node").alias("of"), "lowest"))
    inner.clear()
    out = rows.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(maybe_broadcast(least, 500_000), F.col("node") == F.col("of"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("lowest", "id").alias("component_id"))
