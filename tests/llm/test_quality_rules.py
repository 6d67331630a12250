import random
import re

from pyspark.sql import functions as F

from surgeline.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_measures_match_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", "  \n\t\n", "a", " x y |", "a b c d e f g h " * 30, "# $ % & | < > *\n# $ % & | < > *\n"]
    for _ in range(60):
        w = [r.choice("abcdé\U0001f600") * r.randrange(1, 4) for _ in range(r.randrange(5, 120))]
        if r.random() < 0.5:
            w[20:20] = w[:12]
        texts.append("".join(x + r.choice([" ", "\n", "\t", " | "]) for x in w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "a")], "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_words", "'x' as body")
    got = Q.quality_rules(df, df.limit(0).selectExpr("doc_id as id")).collect()
    assert len(got) == len(texts) + 1
    for g in got:
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute(texts[g.doc_id]), texts[g.doc_id]
        assert g.score == 0 and g.kept == (not g.base_failed)


def test_junk_scores_lower(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("%%%" if i % 4 == 0 else ",") for _ in range(60))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = df.where("doc_id % 4 <> 0 and doc_id < 40").selectExpr("doc_id as id")
    got = {x.doc_id: x.score for x in Q.quality_rules(df, trusted).collect()}
    assert max(v for k, v in got.items() if k % 4 == 0) < min(v for k, v in got.items() if k % 4)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality_rules(df, df.selectExpr("doc_id as id")).count() == 0


def test_scores_match_plain_counts(spark):
    """Two multinomials over the cells, counted one gram at a time, and each document's mean log ratio; repeated rows count, null ids aren't trusted."""
    import numpy as np

    r = random.Random(7)
    word = lambda a: "".join(r.choice(a) for _ in range(4))
    rows = [(i, " ".join(word("abc" if i % 3 else "xyz#") for _ in range(r.randrange(1, 60)))) for i in range(60)] + [(7, "again a b"), (None, "no id here"), (61, ""), (62, None), (63, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "0 as score", "1 as kept", "2 as id")
    trusted = spark.createDataFrame([(i,) for i in [*range(0, 40, 3), 7, 7, 999]] + [(None,)], "id long")
    cells = [x.c for x in spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(rows)], "k long, t string").select("k", Q.token_hashes("t").alias("h")).select("k", Q.buckets(F.col("h")).alias("c")).orderBy("k").collect()]
    n, t = np.ones(Q.BUCKETS), np.ones(Q.BUCKETS)
    for (i, _), c in zip(rows, cells):
        for x in c:
            n[x] += 1
            t[x] += i is not None and (i in range(0, 40, 3) or i == 7)
    ratio = np.log(t / t.sum()) - np.log(n / n.sum())
    got = {}
    for g in Q.quality_rules(df, trusted).collect():
        got.setdefault((g.doc_id, g.text), []).append((g.score, g.base_failed, g.kept))
    for (i, x), c in zip(rows, cells):
        want = ratio[c].mean() if len(c) else 0.0
        for score, failed, kept in got[i, x]:
            assert abs(score - want) < 1e-5 and kept == (not failed and score >= Q.THRESHOLD)
    # tokens are runs of letters and digits, or of anything else but spaces; cells are those of single ones and of neighbours
    assert all(len(c) == max(0, 2 * len(re.findall(r"[\w]+|[^\s\w]+", x or "")) - 1) for (_, x), c in zip(rows, cells))
