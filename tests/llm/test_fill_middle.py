import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from surgeline.llm import fill_middle as M


def plain(doc_id, text, seed=7, rate=100, first=50, sentinels=M.SENTINELS):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = sentinels
    if not text or any(x in text for x in sentinels) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < first:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def made(df, **kw):
    out = M.rearrange(df, **kw)
    kept = {k: v for k, v in kw.items() if k == "sentinels"}
    return out.select("*", M.restored(F.col("output"), F.col("form"), **kept).alias("back")).collect()


@pytest.mark.parametrize("kw", [{}, {"seed": 3, "rate": 40, "suffix_first": 0}, {"suffix_first": 100, "sentinels": ("<|pre|>", "<|suf|>", "<|mid|>")}])
def test_matches_plain_python_and_restores(spark, kw):
    r = random.Random(5)
    bits = ["a", "é", "𝄞", "\n", "\n\n", "\r\n", "<", ">", "<P", "S>", "<<", "P>", " ", "word", "M>", "|", "<|pre"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(0, 30))) for _ in range(400)]
    texts += [None, "", "\n", "\n\n\n", "no break", "x<P>y", "<S>", "a\n<M>", "a\nb\n" * 20_000, "z" * 300_000, "𝄞a" * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, "a\nb\nc\n"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as output", "1 as n", "'y' as units", "2 as form")
    got = made(df, **kw)
    want = [(i, *plain(i, t, kw.get("seed", 7), kw.get("rate", 100), kw.get("suffix_first", 50), kw.get("sentinels", M.SENTINELS)), t or "") for i, t in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[5])
    assert sorted((tuple(g) for g in got), key=key) == sorted(want, key=key)
    assert {g.form for g in got} >= {"plain", "psm" if kw.get("suffix_first", 50) < 100 else "spm"}


def test_units_that_leave_gaps_leave_texts_plain(spark):
    df = spark.createDataFrame([(i, "one two  three") for i in range(5)], "doc_id long, text string")
    assert all(r.form == "plain" and r.back == "one two  three" for r in made(df, units=r"\w+"))
    assert any(r.form != "plain" for r in made(df, units=r"\s*\w+"))


def test_empty_table_and_sentinels_that_overlap(spark):
    assert M.rearrange(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    for bad in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>"), ("<P<", "<S>", "<M>"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            M.rearrange(spark.range(1).selectExpr("id as doc_id", "'' as text"), sentinels=bad)
