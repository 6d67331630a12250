"""Best-fit packing by a grouping genetic algorithm on islands.

What is packed are token counts between 1 and the capacity, so a packing is a
multiset of patterns (what sizes one sequence holds) and the problem is a histogram
with one cell for each size: both stay small however many documents there are.
Crossover injects whole well-filled sequences of one parent into the other, takes
out sequences whose documents then occur twice, and best-fits what these held
besides. Islands evolve in tasks of their own, from tables in the shared folder, and
pass their elite on between epochs. Ranks within each size then tie documents to places.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surgeline.llm.shared import Scratch, maybe_broadcast, text_bytes, tune

CAPACITY = 2048
ISLANDS, EPOCHS, POPULATION, CHILDREN = 4, 4, 5, 8
#: Share of a sequence that must be full for crossover to hand it on whole.
WELL_FILLED = 0.99
#: Patterns of a packing, for each unit of capacity; a child with more does not live. Best-fit adds at most
#: two patterns for each size, and a pattern has at most sqrt(2 * capacity) sizes, so this bounds what
#: reaches the driver and every task, whatever the number of documents.
PATTERNS = 16

#: A pattern: (size, times) by falling size. A packing: how many sequences have each pattern.
Pattern = tuple
Packing = Counter


def filled(pattern: Pattern) -> int:
    return sum(s * n for s, n in pattern)


def with_more(pattern: Pattern, size: int, times: int) -> Pattern:
    sizes = dict(pattern)
    sizes[size] = sizes.get(size, 0) + times
    return tuple(sorted(sizes.items(), reverse=True))


def best_fit(left: Counter, capacity: int, bins: Counter | None = None, order=None) -> Packing:
    """Puts sizes (with counts), in falling order or by falling order(size), into the fullest sequence that has room; equal sequences are filled together."""
    by_room: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, count: int, room: int) -> None:
        if room not in by_room:
            by_room[room] = Counter()
            insort(rooms, room)
        by_room[room][pattern] += count

    for pattern, count in (bins or {}).items():
        put(pattern, count, capacity - filled(pattern))
    for size in sorted(left, key=order, reverse=True):
        count = left[size]
        while count:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if full := count // each:
                    put(((size, each),), full, capacity - each * size)
                if rest := count % each:
                    put(((size, rest),), 1, capacity - rest * size)
                break
            room = rooms[at]
            pattern, bins_here = next(iter(by_room[room].items()))
            each = room // size
            take = min(bins_here, count // each)
            if take:
                extra = each
            else:
                take, extra = 1, count
            by_room[room][pattern] -= take
            if not by_room[room][pattern]:
                del by_room[room][pattern]
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            put(with_more(pattern, size, extra), take, room - extra * size)
            count -= take * extra
    return Counter({p: c for patterns in by_room.values() for p, c in patterns.items()})


def quality(packing: Packing, capacity: int) -> tuple[int, float]:
    """Fewer sequences are better; of equal numbers, fuller and emptier ones rather than middling ones."""
    return -sum(packing.values()), sum(c * (filled(p) / capacity) ** 2 for p, c in packing.items())


def crossover(a: Packing, b: Packing, capacity: int, rng: random.Random) -> Packing:
    """Injects some of b's well-filled sequences into a."""
    child = Counter()
    for p in sorted(b):
        if filled(p) >= WELL_FILLED * capacity and (n := rng.randint(0, b[p])):
            child[p] = n
    given = Counter()
    for p, n in child.items():
        for s, k in p:
            given[s] += n * k
    lost = Counter()
    for p in sorted(a, key=lambda p: (filled(p), p)):  # the emptiest go first
        n = a[p]
        out = min(n, max((-(-given[s] // k) for s, k in p if given[s] > 0), default=0))
        if out:
            for s, k in p:
                dropped = min(max(given[s], 0), out * k)
                given[s] -= dropped
                lost[s] += out * k - dropped
        if n > out:
            child[p] += n - out
    return best_fit(+lost, capacity, child)


def mutate(a: Packing, capacity: int, rng: random.Random) -> Packing:
    """Takes some of the least filled sequences, and a few others, apart and best-fits their documents."""
    kept, lost = Counter(a), Counter()
    worst = sorted((p for p in a if filled(p) < capacity), key=lambda p: (filled(p), p))[: rng.randint(1, 24)]
    for p in {*worst, *rng.sample(sorted(a), min(len(a), 8))}:
        n = min(kept[p], rng.randint(1, 3))
        kept[p] -= n
        for s, k in p:
            lost[s] += n * k
    return best_fit(lost, capacity, +kept)


def lower_bound(sizes: Counter, capacity: int) -> int:
    """No packing has fewer sequences: the sum of sizes, and sizes over half that can't share one."""
    total = sum(s * n for s, n in sizes.items())
    best = -(-total // capacity)
    for k in sorted({s for s in sizes if 2 * s <= capacity} | {0}):
        alone = sum(n for s, n in sizes.items() if s > capacity - k)
        half = [(s, n) for s, n in sizes.items() if capacity / 2 < s <= capacity - k]
        room = sum(n * (capacity - s) for s, n in half)
        rest = sum(s * n for s, n in sizes.items() if k <= s and 2 * s <= capacity)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-(rest - room) // capacity)))
    return best


def settle(sizes: Counter, capacity: int, rng: random.Random) -> list[Packing]:
    """An island's first population: best-fit in falling order, and in orders that chance disturbs."""
    population = [best_fit(sizes, capacity)]
    while len(population) < POPULATION:
        weight = {s: s * rng.uniform(0.6, 1.4) for s in sorted(sizes)}
        population.append(best_fit(sizes, capacity, order=weight.__getitem__))
    return population


def evolve(population: list[tuple[Packing, int]], sizes: Counter, capacity: int, rng: random.Random) -> list[tuple[Packing, int]]:
    """One epoch of one island: (packing, crossovers among its ancestors and itself), best first; all of them hold the same sizes."""
    rank = lambda m: quality(m[0], capacity)
    population = sorted(population or [(p, 0) for p in settle(sizes, capacity, rng)], key=rank, reverse=True)
    for _ in range(CHILDREN):
        if len(population) > 1:
            (a, m), (b, n) = rng.sample(population, 2)
            child = (crossover(a, b, capacity, rng), max(m, n) + 1)
            children = [child, (mutate(child[0], capacity, rng), child[1])]
            population += [c for c in children if len(c[0]) <= PATTERNS * capacity]
        population.sort(key=lambda m: (rank(m), m[1]), reverse=True)
        # equals, such as migrants that return, are one member
        population = [m for i, m in enumerate(population) if i == 0 or m[0] != population[i - 1][0]][:POPULATION]
    return population


def island_epoch(epoch: int, sizes: Counter, capacity: int):
    """Arrow function of one island's rows (island, member, crossed, size list, times list, n), a row for each pattern, to those after an epoch; a member below 0 only names the island."""
    import pyarrow as pa

    def run(table):
        island = table.column("island")[0].as_py()
        packings: dict[int, Packing] = {}
        crossed: dict[int, int] = {}
        for r in table.to_pylist():
            if r["member"] >= 0:
                packings.setdefault(r["member"], Counter())[tuple(zip(r["sizes"], r["times"]))] = r["n"]
                crossed[r["member"]] = r["crossed"]
        out = evolve([(packings[m], crossed[m]) for m in sorted(packings)], sizes, capacity, random.Random(1000 * epoch + island))
        rows = [(island, m, c, [s for s, _ in p], [k for _, k in p], n) for m, (packing, c) in enumerate(out) for p, n in sorted(packing.items())]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["island", "member", "crossed", "sizes", "times", "n"])

    return run


def pack_sizes(spark: SparkSession, sizes: Counter, capacity: int, scratch: Scratch | None = None) -> tuple[Packing, int]:
    """The best packing that the islands find for a histogram of sizes, and the crossovers behind it.

    Populations are tables; of them the driver gets each island's score and the
    best packing's patterns, of which PATTERNS bounds the number.
    """
    if not sizes:
        return Counter(), 0
    scratch = scratch or Scratch(spark, "packing")
    schema = "island int, member int, crossed int, sizes array<int>, times array<int>, n long"
    none = F.array().cast("array<int>")
    state = spark.range(ISLANDS).select(F.col("id").cast("int").alias("island"), F.lit(-1).alias("member"), F.lit(0).alias("crossed"), none.alias("sizes"), none.alias("times"), F.lit(0).cast("long").alias("n"))
    for epoch in range(EPOCHS):
        state = scratch.table(state.groupBy("island").applyInArrow(island_epoch(epoch, sizes, capacity), schema))
        # each island's elite migrates to the next
        elite = state.where("member = 0")
        if epoch + 1 < EPOCHS:
            state = state.union(elite.select(((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.lit(POPULATION).alias("member"), "crossed", "sizes", "times", "n"))
    full = F.aggregate(F.zip_with("sizes", "times", lambda s, k: s * k), F.lit(0), lambda a, x: a + x) / F.lit(capacity)
    best = elite.groupBy("island").agg(F.sum("n").alias("many"), F.sum(F.col("n") * full * full).alias("fill")).orderBy("many", F.desc("fill"), "island").first()["island"]
    rows = elite.where(F.col("island") == best).collect()
    return Counter({tuple(zip(r["sizes"], r["times"])): r["n"] for r in rows}), rows[0]["crossed"]


def pieces_of(path: str, capacity: int):
    """Arrow function: (id, text) to pieces; nth numbers a task's pieces of each length."""
    import pyarrow as pa

    def run(batches):
        import zlib

        from pyspark import TaskContext

        from surgeline.llm.tokens import tokenizer_of

        tokenizer, task, seen = tokenizer_of(path), TaskContext.get().partitionId(), Counter()
        names = ["id", "piece", "start", "length", "crc", "task", "nth"]
        kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            ids, at = tokenizer.encode(*text_bytes(batch.column(1)))
            n = len(batch)
            raw = memoryview(np.insert(ids, at[1:], 0).astype("<u4").tobytes())
            at = at + np.arange(n + 1)
            size = np.diff(at)
            pieces = -(-size // capacity)
            row = np.repeat(np.arange(n), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            begin = at[row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            nth = []
            for k in length.tolist():
                nth.append(seen[k])
                seen[k] += 1
            cols = [piece, start, length, crc, np.full(len(row), task), nth]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *[pa.array(c, k) for c, k in zip(cols, kinds[1:])]], names)

    return run


def places_of(packing: Packing, first: int):
    """Arrow function: rows (id, piece, start, length, crc, rank) to their places. rank numbers the pieces of a length from 0."""
    import pyarrow as pa

    keys, begin, offset, base, times = [], [], [], [], []
    used: Counter = Counter()
    for p in sorted(packing, reverse=True):
        at = 0
        for s, k in p:  # the k places of a size are next to each other in a sequence
            keys.append((s << 40) + used[s])
            begin.append(used[s])
            offset.append(at)
            base.append(first)
            times.append(k)
            used[s] += packing[p] * k
            at += s * k
        first += packing[p]
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    keys, begin, offset, base, times = (np.array(x, np.int64)[order] for x in (keys, begin, offset, base, times))

    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 40) + rank, "right") - 1
            which, slot = np.divmod(rank - begin[at], times[at]) if len(at) else (rank, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base[at] + which), pa.array(offset[at] + slot * length)], ["id", "piece", "start", "length", "crc", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into few sequences of at most capacity tokens.

    A document's tokens are its text's ids and then id 0. Longer documents are
    cut into pieces of capacity tokens, the last of which may be shorter; others
    stay whole. Returns a row for each piece: id, piece, start, length,
    ids_crc32, sequence_id, offset. Places in a sequence are gapless from 0.
    Null and empty texts are documents of the one token 0. Repeated rows, and
    rows that share an id or have none, are packed each for itself; pieces of equal length
    are interchangeable, and are placed in the order of tasks and rows. An empty
    table gives no rows. Other columns are not read. tokenizer_path: a
    word-level file of the tokenizers library, readable on every executor.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    pieces = scratch.table(docs.mapInArrow(pieces_of(tokenizer_path, capacity), f"id {kind}, piece int, start long, length long, crc long, task int, nth long"))
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    sizes = Counter({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()})  # at most capacity rows
    full = sizes.pop(capacity, 0)  # full pieces are sequences of their own
    packing, _ = pack_sizes(spark, sizes, capacity, scratch)
    if full:
        packing[((capacity, 1),)] = full
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most capacity rows for each task
    starts = scratch.table(counts.select("length", "task", before.alias("before")))
    ranked = pieces.join(maybe_broadcast(starts, 200_000), ["length", "task"]).select("id", "piece", "start", "length", "crc", (F.col("before") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(places_of(packing, 0), f"id {kind}, piece int, start long, length long, crc long, sequence_id long, offset long")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
