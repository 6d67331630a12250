import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surgeline.llm import jaccard


def brute(rows, words, num, den):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").encode().lower().split()
        g = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
        sets.append(g or ({tuple(w)} if w else set()))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "one two"), (5, " \n\t "), (6, "é à ü"), (7, "É à ü")]
    passage = [r.choice(vocab) for _ in range(30)]
    for i in range(8, n):
        w = [r.choice(vocab) for _ in range(r.choice([4, 6, 9, 14, 25, 60, 150]))]
        if i % 3 == 0:
            w = rows[r.randrange(8, i)][1].split() if i > 12 else w
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            w = w[r.randrange(0, 2) : len(w) - r.randrange(0, 2)]
        elif i % 7 == 0:
            w += passage
        rows.append((i * 3, " ".join(w)))
    return rows + [rows[20], rows[21], rows[21]]


@pytest.mark.parametrize("words,num,den,seed,together", [(3, 90, 100, 1, 32), (5, 80, 100, 2, 2), (3, 80, 100, 3, 2), (1, 60, 100, 4, 32)])
def test_matches_all_pairs(spark, monkeypatch, words, num, den, seed, together):
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("th", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in jaccard.jaccard_components(df, words, num, den).collect()), key=str)
    assert got == brute(rows, words, num, den)


def test_families_in_a_crowd(spark, monkeypatch):
    """Texts of shared passages with families of near copies among them: no link is lost to columns that many sets have."""
    monkeypatch.setattr(jaccard, "TOGETHER", 3)
    r = random.Random(12)
    passages = [" ".join(f"p{k}x{i}" for i in range(40)) for k in range(3)]
    rows = []
    for i in range(60):
        rows.append((len(rows), " ".join([r.choice(passages), *(f"u{i}y{j}" for j in range(r.choice([5, 12, 40]))), r.choice(passages)])))
    for k in range(4):
        base = (passages[k % 3] + " " + " ".join(f"f{k}z{j}" for j in range(30))).split()
        for _ in range(25):
            w = list(base)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = f"q{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(x) for x in jaccard.jaccard_components(df, 5, 80, 100).collect()), key=str)
    want = brute(rows, 5, 80, 100)
    assert got == want and len({x[2] for x in want}) < len(rows)


def test_parts_of_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 60)
    rows = corpus(9, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.jaccard_components(df, 3, 80, 100).collect()), key=str)
    assert got == brute(rows, 3, 80, 100)


def test_null_ids_link(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (None, "x y z")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str) == [(4, 2, 4), (None, 1, None), (None, 2, 4), (None, 2, 4)]
    # a chain over a document without an id, and a component without any
    words = [f"w{i}" for i in range(60)]
    chain = [(d, " ".join(words[3 * k : 3 * k + 50])) for k, d in enumerate([9, None, 5])] + [(None, "q " * 9 + f"r{k}") for k in range(2)] + [(None, None), ("7", "")]
    rows = [(int(d) if d is not None else None, t) for d, t in chain]
    got = sorted((tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()), key=str)
    assert got == brute(rows, 3, 80, 100) and (9, 48, 5) in got


def test_string_ids_and_long_texts(spark):
    r = random.Random(3)
    long = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    rows = [("b", " ".join(long)), ("a", " ".join(long[:-100] + ["x"] * 100)), ("c", "w1 " * 50_000), ("d", "w1 w1 w1")]
    got = {x[0]: tuple(x) for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id string, text string"), 3, 90, 100).collect()}
    assert got["a"][2] == got["b"][2] == "a" and got["c"][1:] == got["d"][1:] == (1, "c")


def test_kept_entries_share_enough():
    r = np.random.default_rng(6)
    for num in (60, 80, 90):
        for n in [1, 2, 3, 5, 9, 14, 40, 100, 333, 900]:
            for _ in range(30):
                a = r.permutation(1 << 20)[:n]
                drop, add = r.integers(0, n // 4 + 1), r.integers(0, n // 4 + 1)
                b = np.unique(np.r_[a[drop:], (1 << 20) + r.permutation(1 << 10)[:add]])
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= num * (len(a) + len(b) - both):
                    place = r.permutation(1 << 21)  # any order
                    first = lambda x: x[np.argsort(place[x])][: jaccard.kept_of(len(x), num, 100)]
                    assert np.intersect1d(first(a), first(b)).size >= min(jaccard.need_of(len(a), num, 100), jaccard.need_of(len(b), num, 100))


def test_pairs_across_batches():
    import pyarrow as pa

    r = np.random.default_rng(2)
    crowds = {3, 5}
    rows = sorted({(int(s), int(v)) for s, v in zip(np.r_[r.integers(0, 40, 200), np.full(300, 7)], r.integers(0, 200, 500))})
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows[i : i + size]], pa.int64()), pa.array([x[0] in crowds for x in rows[i : i + size]]), pa.array([x[1] for x in rows[i : i + size]], pa.int64())], ["sig", "crowd", "node"]) for i in range(0, len(rows), size)]
        got = sorted((x["a"], x["b"], x["large"]) for b in jaccard.pairs(16)(iter(batches)) for x in b.to_pylist())
        want = []
        for s in {x[0] for x in rows}:
            v = [x[1] for x in rows if x[0] == s]
            want += [(b, s, True) for b in v] if len(v) > 16 or s in crowds else [(b, a, False) for i, a in enumerate(v) for b in v[i + 1 :]]
        assert got == sorted(want)
