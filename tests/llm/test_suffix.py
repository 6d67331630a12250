import random
from collections import Counter

import pytest

from surgeline.llm import suffix


def brute(rows, length):
    count = Counter()
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        hit = [False] * (len(b) + 1)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                hit[i : i + length] = [True] * length
        spans = sum(hit[i] and not (i and hit[i - 1]) for i in range(len(b)))
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((d, len(b), len(b) - len(kept), spans, kept))
    return sorted(out, key=str)


def run(spark, rows, length, gram):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as h", "2 as seg").repartition(3)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix.remove_repeats(df, length, gram).collect()), key=str)


def corpus(seed, length):
    r = random.Random(seed)
    rand = lambda n, a="abcdeé ": "".join(r.choice(a) for _ in range(n))
    passage, short = rand(3 * length), rand(length - 1, "xyz")
    rows = [(0, None), (1, ""), (2, "a" * 5 * length), (3, rand(length - 1)), (4, short), (5, "q" + short + "p"), (6, "ab" * length)]
    for i in range(7, 50):
        t = rand(r.choice([5, length, 4 * length]))
        if i % 3 == 0:
            a = r.randrange(0, 2 * length)
            t += passage[a : a + r.randrange(length - 3, 2 * length)] + rand(9)
        if i % 5 == 0:
            t = rows[-1][1]
        if i % 7 == 0:
            t = t + t
        rows.append((i, t))
    return [*rows, rows[9], rows[9], (None, rows[12][1])]


@pytest.mark.parametrize("seed,length,gram", [(1, 40, 8), (2, 40, 16), (3, 12, 9), (4, 64, 32)])
def test_matches_brute_force(spark, seed, length, gram):
    rows = corpus(seed, length)
    assert run(spark, rows, length, gram) == brute(rows, length)


def test_wide_anchors_and_long_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 64)
    monkeypatch.setattr(suffix, "PIECE", 100)
    rows = corpus(6, 40)
    assert run(spark, rows, 40, 8) == brute(rows, 40)


def test_empty(spark):
    assert run(spark, [], 40, 8) == []
    assert run(spark, [(1, None)], 40, 8) == [(1, 0, 0, 0, b"")]


def test_pieces_give_the_same_anchors(monkeypatch):
    import numpy as np

    x = np.frombuffer("".join(random.Random(1).choice("abcd") for _ in range(900)).encode(), np.uint8)

    def by_window():
        return [(h, k) for h, _, s, n in zip(*suffix.anchors(x, 40, 8)) for k in range(s, s + n - 39)]

    whole = by_window()
    monkeypatch.setattr(suffix, "PIECE", 100)
    assert sorted(by_window()) == sorted(whole) and len(whole) == 900 - 39


def test_one_window_in_many_contexts():
    """Rows of one window are cut into transforms of a few, and all of them are found; a window that stands once isn't."""
    import pyarrow as pa

    rows = [(1, k, 7, b"w" * 40, False, True) for k in range(3000)] + [(2, 0, 0, b"x" * 20 + b"y" * 20, False, True), (3, 1, 0, b"z" * 41, True, False)]
    names = ["block", "seg", "off", "part", "many", "wide"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + 700]], pa.schema([("block", pa.int64()), ("seg", pa.int64()), ("off", pa.int64()), ("part", pa.binary()), ("many", pa.bool_()), ("wide", pa.bool_())])) for i in range(0, len(rows), 700)]
    out = [b.to_pylist() for b in suffix.transform_blocks(40, 400)(iter(batches))]
    assert max(map(len, out)) <= 12
    found = {}
    for r in (r for b in out for r in b):
        found.setdefault(r["seg"], set()).update(r["runs"])
    assert all(found[k] >= {7, 8} for k in range(2, 3000)) and sum(r["seg"] == 0 and r["runs"] == [] for b in out for r in b) == 1


def test_windows_of_a_batch_share_a_row():
    import pyarrow as pa

    cut = {"h": 5, "start": 0, "size": 50, "many": False, "wide": True}
    text = "".join(random.Random(2).choice("abcdef") for _ in range(50))
    kind = pa.list_(pa.struct([("h", pa.int64()), ("seg", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("many", pa.bool_()), ("wide", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 9), pa.array([[cut | {"seg": k}] for k in range(9)], kind)], ["text", "cuts"])
    rows = next(suffix.cut_out(40)(iter([batch]))).to_pylist()
    blocks = {}
    for r in rows:
        blocks.setdefault(r["block"], []).append(r)
    assert len(rows) == 9 * 11 and len(blocks) == 9 * 11 and all(r["many"] for r in rows)


def test_copies_of_a_text_give_the_stretches_of_one(spark):
    """400 copies in 40 batches of 2 tasks: a block gets a row of each task, not of each copy."""
    import pyarrow as pa

    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(3000))
    cuts = [{"h": k, "seg": 10 + k, "start": 100 * k, "size": 260, "many": False, "wide": k == 2} for k in range(3)]
    kind = pa.list_(pa.struct([("h", pa.int64()), ("seg", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("many", pa.bool_()), ("wide", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 10, pa.int64()), pa.array([text] * 10), pa.array([cuts] * 10, kind)], ["th", "text", "cuts"])
    rows = [r for b in suffix.of_first_copies(suffix.cut_out(200))(iter([batch] * 20)) for r in b.to_pylist()]
    assert len(rows) == 2 + 61 and len({(r["seg"], r["off"]) for r in rows}) == len(rows)
