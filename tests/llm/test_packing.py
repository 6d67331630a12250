import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from surgeline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, capacity):
    tok = Tokenizer.from_file(PATH)
    want = []
    for d, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_round_trip(spark):
    r = random.Random(4)
    v = ["The", "thntblere", "É", "of.", "123", "don't", "ça", "日本", "<|endoftext|>", "x́", "!!", " "]
    docs = [(0, None), (1, ""), (2, " "), (2, "a"), (None, "b c"), (None, "b c")] + [(i, " ".join(r.choice(v) for _ in range(r.choice([1, 5, 30, 200])))) for i in range(3, 80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as piece", "2 as length").repartition(5)
    n = check(packing.pack(df, PATH, 64).collect(), docs, 64)
    lens = Counter(r.length for r in packing.pack(df, PATH, 64).collect())
    assert n <= packing.lower_bound(lens, 64) + 1


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def amounts(packing):
    out = Counter()
    for p, n in packing.items():
        for size, times in p:
            out[size] += n * times
    return out


def test_operators_keep_every_size():
    r = random.Random(2)
    for _ in range(30):
        cap = r.choice([10, 50, 300])
        sizes = Counter(r.randint(1, cap) for _ in range(r.choice([5, 100, 800])))
        a, *others = packing.settle(sizes, cap, r)
        b = packing.mutate(a, cap, r)
        for p in (a, b, *others, packing.crossover(a, b, cap, r), packing.crossover(b, packing.mutate(b, cap, r), cap, r), packing.crossover(others[0], a, cap, r)):
            assert amounts(p) == sizes
            assert all(packing.filled(q) <= cap for q in p)
            assert sum(p.values()) >= packing.lower_bound(sizes, cap)
            assert len(p) <= packing.PATTERNS * cap


def exact(sizes, capacity):
    """Fewest sequences, by trying every place for every document."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in sorted({r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values()):
            rooms[k] -= sizes[i]
            place(i + 1, rooms)
            rooms[k] += sizes[i]
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_small_inputs_are_packed_as_well_as_can_be():
    r = random.Random(5)
    for trial in range(40):
        documents = [r.randint(5, 60) for _ in range(r.randint(1, 11))]
        islands = [[] for _ in range(packing.ISLANDS)]
        for epoch in range(packing.EPOCHS):
            islands = [packing.evolve(p, Counter(documents), 100, random.Random(1000 * epoch + i)) for i, p in enumerate(islands)]
        best = max((p[0][0] for p in islands), key=lambda p: packing.quality(p, 100))
        assert sum(best.values()) == exact(documents, 100), documents


def test_crossover_decides(spark):
    """On a histogram with a tight bound the best packing comes from crossovers, and is no worse than best-fit."""
    r = random.Random(9)
    sizes = Counter(min(2048, int(r.lognormvariate(5.5, 1.0)) + 1) for _ in range(3000))
    best, crossed = packing.pack_sizes(spark, sizes, 2048)
    assert amounts(best) == sizes and crossed > 0
    assert packing.quality(best, 2048) > packing.quality(packing.best_fit(sizes, 2048), 2048)
    assert sum(best.values()) >= packing.lower_bound(sizes, 2048)


def test_long_texts(spark):
    docs = [(1, "the " * 100_000), (2, "word, " * 30_000), (3, "x" * 50_000), (4, None)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()
    check(rows, docs, 2048)
