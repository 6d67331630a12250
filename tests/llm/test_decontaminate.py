import random
import re

from surgeline.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for i, q in items:
            v = words(q)
            n = min(10, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), ",".join(sorted(ids))))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as words", "1 as len")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in contamination(d, b).collect()), key=str)


def test_matches_brute_force(spark):
    r = random.Random(3)
    v = ["Été", "the", "A", "cat", "x1", "É", "ÀB", "dog", "ÇA", "run"]
    items = [(i, " ".join(r.choice(v) for _ in range(r.choice([0, 1, 2, 4, 7, 9, 10, 11, 14, 40])))) for i in range(24)] + [(100, None), (101, "the the"), (7, "cat dog run"), (102, "cat dog run")]
    docs = [(0, None), (1, ""), (2, "..."), (3, "the the the"), (3, "the the the")]
    for i in range(4, 60):
        w = [r.choice(v) for _ in range(r.choice([3, 20, 80]))]
        if i % 2:
            q = words(r.choice(items)[1])
            a = r.randrange(0, max(1, len(q)))
            w[5:5] = [x.upper() if r.random() < 0.5 and x.isascii() else x for x in q[a : a + r.randrange(5, 30)]]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    docs.append((None, docs[9][1]))
    assert run(spark, docs, items) == brute(docs, items)


def test_no_items_and_no_documents(spark):
    docs = [(1, "a b c"), (2, None)]
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, docs, [(1, "  ")]) == brute(docs, [])
    assert run(spark, [], [(1, "a b")]) == []


def test_letters_with_several_small_forms(spark):
    """Texts that lower-casing changes in length or by context match as they are, and only as they are."""
    item = "ΑΣ'Α İstanbul K1 word ΣΑΣ b c d e f g"
    docs = [(1, "x. " + item + ". y"), (2, item.replace("ΑΣ'", "ας'")), (3, item.replace("word", "WORD")), (4, item.replace("İ", "i")), (5, item + "Σ")]
    assert run(spark, docs, [(1, item)]) == brute(docs, [(1, item)])
    assert {r[0] for r in run(spark, docs, [(1, item)]) if r[2] == 12} == {1, 3}


def test_long_texts(spark):
    r = random.Random(1)
    item = " ".join(f"w{r.randrange(50)}" for _ in range(400))
    docs = [(1, "a " * 40_000 + item + " b" * 40_000), (2, "c" * 200_000)]
    assert run(spark, docs, [(1, item)]) == brute(docs, [(1, item)])
