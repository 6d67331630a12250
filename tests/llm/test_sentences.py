import random
import re

from surgeline.llm import sentences as S


def units(text):
    b = (text or "").encode()
    out, cur, last = [], [], None
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", b):
        if cur and (last[0][-1:] in (b".", b"!", b"?") or b"\n" in b[last.end() : m.start()]):
            out += [cur[k : k + S.LONG] for k in range(0, len(cur), S.LONG)]
            cur = []
        cur.append((m[0].lower(), m.start()))
        last = m
    return out + [cur[k : k + S.LONG] for k in range(0, len(cur), S.LONG)], b


def brute(rows):
    docs = sorted({(d, t) for d, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, out = set(), {}
    for d, t in docs:
        u, b = units(t)
        gone = set()
        for i in range(len(u)):
            j, n = i, 0
            while j < len(u) and (j - i < S.RUN or n < S.WORDS):
                n += len(u[j])
                j += 1
            if j - i < S.RUN or n < S.WORDS:
                continue
            key = tuple(w for x in u[i:j] for w, _ in x)
            if key in seen:
                gone.update(range(i, j))
            seen.add(key)
        bounds = [x[0][1] for x in u] + [len(b)]
        kept = b[: bounds[0]] + b"".join(b[bounds[k] : bounds[k + 1]] for k in range(len(u)) if k not in gone)
        out[d, t] = (d, len(u), len(gone), kept.decode())
    return sorted((out[d, t] for d, t in rows), key=str)


def test_matches_brute_force(spark):
    r = random.Random(5)
    sent = lambda n: " ".join(r.choice(["aa", "Bb", "é", "c,"]) + str(r.randrange(99)) for _ in range(n)) + r.choice([".", "!", "?\n", "\n", ". "])
    passage = [sent(r.randrange(2, 30)) for _ in range(9)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one. two. three."), (None, " ".join(passage))]
    for i in range(4, 70):
        s = [sent(r.randrange(1, 20)) for _ in range(r.randrange(1, 12))]
        if i % 2:
            a = r.randrange(0, 6)
            s[2:2] = passage[a : a + r.randrange(1, 6)]
        if i % 9 == 0:
            s = [rows[-1][1]]
        if i % 11 == 0:
            s = s + s
        rows.append((1000 - i, " ".join(s)))
    rows.append(rows[12])
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as h", "2 as th").repartition(3)
    got = sorted(((x.doc_id, x.n_sentences, x.n_removed, x.kept) for x in S.remove_spans(df).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert S.remove_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_passage_behind_prefixes_of_any_length(spark):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**6)}"
    for size, least in ((S.RUN * S.LONG + 3 * S.NEAR - 2, S.RUN * S.LONG), (60, S.RUN * S.LONG)):
        passage = [word() for _ in range(size)]
        own = [([word() for _ in range(k)], [word() for _ in range(30 - k)]) for k in range(27)]
        rows = [(k, " ".join([*a, *passage, *b])) for k, (a, b) in enumerate(own)]
        got = {x.doc_id: x for x in S.remove_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        assert got[0].kept == rows[0][1] and not got[0].n_removed
        for k, (a, b) in enumerate(own[1:], 1):
            kept = got[k].kept.split()
            gone = size - sum(w in set(passage) for w in kept)
            assert gone >= least and kept[: len(a)] == a and kept[len(kept) - len(b) :] == b


def test_long_sentences_of_one_word(spark):
    rows = [(0, "x " * 500), (1, "y " + "x " * 500)]
    got = {x.doc_id: x.kept.split() for x in S.remove_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got[0]) == {"x"} and got[1][0] == "y"


def test_ids_of_any_kind_and_long_texts(spark):
    passage = "One of these sentences is here. It goes on with words. And a third one ends the run of them all. "
    docs = [("b", "First. " + passage), ("a", "Second. " + passage), (None, "Third. " + passage), (None, "Third. " + passage), ("long", "word " * 60_000 + ". " + passage), ("empty", "")]
    got = S.remove_spans(spark.createDataFrame(docs, "doc_id string, text string").selectExpr("doc_id", "text", "1 as key", "2 as th")).collect()
    assert len(got) == 6
    left = [r for r in got if r.kept and "It goes on" in r.kept]
    # of five places one document keeps the passage: the one without an id, which stands twice and comes first
    assert [r.doc_id for r in left] == [None, None] and {r.doc_id for r in got if r.n_removed >= 3} == {"a", "b", "long"}
    low = -(1 << 63)
    rows = spark.createDataFrame([(low, "X. " + passage), (None, "X. " + passage), (3, "Y. " + passage)], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in S.remove_spans(rows).collect()}
    assert sum("It goes on" in k for k in kept.values()) == 1
