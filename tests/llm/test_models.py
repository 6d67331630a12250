import random

import numpy as np
from pyspark.sql import functions as F

from surgeline.llm import language, quality_model
from surgeline.llm.shared import held_out


def test_quality_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = labels.where(~held_out("doc_id")).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    out = quality_model.classify(docs, known)
    assert out.count() == docs.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    r = out.join(labels, "doc_id").where(held_out("doc_id")).select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("double"))).first()
    assert r[0] > 0.93


def test_quality_edges(spark):
    rows = [(1, "good text here", "x"), (2, None, "x"), (2, None, "x"), (3, "", "x"), (None, "bad %%%", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    none = spark.createDataFrame([], "id long, label int")
    assert {r.score for r in quality_model.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 0), (9, 1), (None, 0), (3, None)], "id long, label int")
    out = quality_model.classify(docs, one).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id in (2, 3)}) == 1
    assert quality_model.classify(docs.limit(0), one).count() == 0


def test_dual_coordinate_descent_separates():

    r = np.random.default_rng(1)
    cells = [np.unique(r.integers(0, 50, 8) + (1000 if i % 3 else 2000)).astype(np.int32) for i in range(300)]
    y = np.array([int(i % 3 > 0) for i in range(300)])
    (w, ratio), a, b = quality_model.fit(cells, y)
    margin = np.array([w[c].sum() / np.sqrt((ratio[c] ** 2).sum()) for c in cells])
    assert (((a * margin + b) > 0) == (y > 0)).all() and a > 0


def test_ratios_and_duals_match_plain_computation():
    """Class shares counted one by one; duals against projected gradient steps on the dual problem in full."""

    r = np.random.default_rng(4)
    cells = [np.unique(r.integers(0, 9, r.integers(1, 7))).astype(np.int32) for _ in range(14)]
    y = np.where(r.random(14) < 0.5, 1.0, -1.0)
    ratio = quality_model.count_ratios(cells, y)
    for c in range(12):
        n = {t: quality_model.SMOOTH + sum(c in x for x, z in zip(cells, y) if z == t) for t in (1, -1)}
        total = {t: quality_model.CELLS * quality_model.SMOOTH + sum(len(x) for x, z in zip(cells, y) if z == t) for t in (1, -1)}
        assert abs(ratio[c] - np.log(n[1] / total[1] / (n[-1] / total[-1]))) < 1e-9
    dense = np.zeros((14, 10))
    dense[:, 9] = 1.0  # the constant
    for i, c in enumerate(cells):
        dense[i, c] = ratio[c]
    most = r.uniform(0.3, 2.0, 14)
    w, bias, alpha = quality_model.descend(cells, [ratio[c] for c in cells], y, most, epochs=4000)
    q = (dense * y[:, None]) @ (dense * y[:, None]).T
    plain, rate = np.zeros(14), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(200_000):
        plain = np.clip(plain - rate * (q @ plain - 1), 0, most)
    goal = lambda a: 0.5 * a @ q @ a - a.sum()
    assert abs(goal(alpha) - goal(plain)) < 1e-6 and (alpha >= 0).all() and (alpha <= most).all()
    assert np.allclose(np.r_[w[:9], bias], (dense * (alpha * y)[:, None]).sum(axis=0))


def test_scores_match_plain_sums(spark):
    """Each document's score from the model's numbers, its indicators found one token at a time."""

    from surgeline.llm import kernels as K

    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["good", "fine", "text"] if i % 2 else ["bad", "%%%", "x1"]) for _ in range(r.randrange(1, 30)))) for i in range(60)] + [(60, None), (61, "word " * 40_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as score", "2 as label")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "id long, label int")
    model = quality_model.fit_model(df.selectExpr("doc_id as id", "text"), labels)
    n = quality_model.CELLS
    w, ratio, (a, b) = model[:n], model[n : 2 * n], model[2 * n :]
    got = {x.doc_id: x.score for x in quality_model.classify(df, labels).collect()}
    for i, text in docs[:61]:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        tokens, _ = K.token_hashes(raw, np.array([0, len(raw)]))
        cells = {int(t) % n for t in tokens}
        for k in range(len(tokens) - 1):
            pair = int(K.gram_hashes(tokens[k : k + 2], 2)[0])
            for apart in (1, 2):
                if k + 2 * apart < len(tokens) and tokens[k] == tokens[k + apart] == tokens[k + 2 * apart]:
                    pair = apart
            cells.add(pair % n)
        c = sorted(cells)
        z = a * w[c].sum() / max(np.sqrt((ratio[c] ** 2).sum()), 1e-12) + b
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-5
    assert 0 <= got[61] <= 1


def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs, docs.where(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "text", "lang"))
    r = out.join(docs.select("doc_id", "lang"), "doc_id").where(held_out("doc_id")).select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert r[0] > 0.97


def test_language_edges(spark):
    r = random.Random(1)
    say = {"aa": ["kaka", "momo", "kimo"], "bb": ["ßüßü", "ütü", "füß"]}
    rows = [(i, " ".join(r.choice(say["aa" if i % 2 else "bb"]) for _ in range(30)), "aa" if i % 2 else "bb") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, None), (101, "", None), (102, "123 ... !", None), (103, "日本", None), (103, "日本", None), (None, "kaka momo", None)], "doc_id long, text string, lang string")
    known = docs.where("doc_id < 40").selectExpr("doc_id as id", "text", "lang")
    got = {}
    for x in language.identify(docs, known).collect():
        got.setdefault(x.doc_id, []).append((x.lang_pred, x.score))
    assert all(got[i][0][0] == lang for i, _, lang in rows)
    assert got[100] == got[101] == got[102] == [("und", 0.0)]
    assert len(got[103]) == 2 and got[103][0][0] in ("aa", "bb") and got[None][0][0] == "aa"
    assert {x.lang_pred for x in language.identify(docs, known.limit(0)).collect()} == {"und"}
    assert language.identify(docs.limit(0), known).count() == 0


def test_posteriors_match_enumeration():
    import itertools


    r = np.random.default_rng(3)
    scores, between = r.normal(size=(9, 3)), r.normal(size=(3, 3))
    first = np.array([0, 4, 4, 9])
    p = language.posteriors(scores, first, between)
    for a, b in ((0, 4), (4, 9)):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.exp(sum(scores[a + i, k] for i, k in enumerate(path)) + sum(between[x, y] for x, y in zip(path, path[1:])))
            for i, k in enumerate(path):
                want[i, k] += w
        assert np.allclose(p[a:b], want / want.sum(axis=1, keepdims=True))


def test_gradients_match_enumeration():
    import itertools


    r = np.random.default_rng(5)
    scores, between, y = r.normal(size=(9, 3)), 2 * r.normal(size=(3, 3)), r.integers(0, 3, 9)
    first = np.array([0, 5, 5, 6, 9])
    by_word, by_pair = language.gradients(scores, first, between, y)
    want_word, want_pair = np.zeros((9, 3)), np.zeros((3, 3))
    for a, b in zip(first[:-1], first[1:]):
        paths = list(itertools.product(range(3), repeat=b - a))
        weight = np.array([np.exp(sum(scores[a + i, k] for i, k in enumerate(p)) + sum(between[x, z] for x, z in zip(p, p[1:]))) for p in paths])
        weight /= weight.sum()
        for p, w in [*zip(paths, -weight), (tuple(y[a:b]), 1.0)]:
            for i, k in enumerate(p):
                want_word[a + i, k] += w
            for x, z in zip(p, p[1:]):
                want_pair[x, z] += w
    assert np.allclose(by_word, want_word) and np.allclose(by_pair, want_pair)


def test_sample_bounds(spark):
    rows = [(i % 50, f"text {i % 50} {i % 3}", "aa") for i in range(400)] + [(i, "other", f"l{i}") for i in range(5)] + [(7, None, "aa"), (None, "x", "aa"), (8, "x", None)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    count = lambda s, n: {r.lang: r["count"] for r in language.sample_of(df, s, n).groupBy("lang").count().collect()}
    assert count(20, 1000) == {"aa": 20, **{f"l{i}": 1 for i in range(5)}}
    assert count(20, 12) == {"aa": 2, **{f"l{i}": 1 for i in range(5)}} and count(100, 1000)["aa"] == 50


def test_language_of_long_texts_and_clashing_columns(spark):
    rows = [(1, "kaka momo " * 50_000, "aa"), (2, "füß ütü " * 50_000, "bb"), (3, "momo " * 3, None), (4, "ütü", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as score", "2 as shares")
    out = language.identify(docs, docs.where("lang is not null").selectExpr("doc_id as id", "text", "lang"))
    assert {r.doc_id: r.lang_pred for r in out.collect()} == {1: "aa", 2: "bb", 3: "aa", 4: "bb"}


def test_language_fits_alike_in_blocks_of_any_size():
    r = np.random.default_rng(8)
    texts = [" ".join("".join(r.choice(list("abcdefgh" if k % 3 else "opqrstuv"), 4)) for _ in range(120)).encode() + b" " for k in range(9)] + [b"", b"12 "]
    labels = np.array([k % 3 for k in range(len(texts))])
    whole = language.fit(texts, labels, 3)
    for block, kept in ((1, 10**6), (1, 0), (5000, 0)):
        parts = language.fit(texts, labels, 3, block, kept)
        assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(whole, parts))


def test_language_fit_takes_the_memory_of_a_block():
    import tracemalloc

    r = np.random.default_rng(9)
    turns, language.TURNS = language.TURNS, 1
    peaks = []
    try:
        for many in (1, 4):
            texts = [b" ".join(bytes(r.integers(97, 123, 6).tolist()) for _ in range(400)) + b" " for _ in range(40 * many)]
            labels = np.arange(len(texts)) % 20
            tracemalloc.start()
            language.fit(texts, labels, 20, 1 << 18, 0)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    finally:
        language.TURNS = turns
    # 48,000 words more, whose pairs of labels alone would take 150 MB
    assert peaks[1] < peaks[0] + 20e6
