import random
import re

from pyspark.sql import functions as F

from surgeline.llm import pii
from surgeline.llm.shared import Scratch


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isascii() and c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_matches_plain_patterns():
    r = random.Random(7)
    parts = ["a@b.c", "@", ".", "x_y@", "1.2.3.4", "255.256.1.1", "+1 (017) 555-7713", "4111 1111 1111 1111", "4111-1111", "9" * 15, "é", " ", "-", "a", "0", "%", "\n", "+", "(", "_", "mail.example.com", "٣"]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(0, 14)))
        assert pii.base_entities(t) == brute(t), repr(t)
    for long in ("a" * 60_000 + "@", "1" * 60_000, "1." * 30_000, "+1" * 20_000, "1 " * 30_000):
        pii.base_entities(long)


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"Hello there. Please write to contact address u{i}@mail.example.com today or not") for i in range(8)]
    rows += [(100, "Now use contact address AB-12345-X today"), (101, "the AB-12345-X again"), (102, "there were 123456 people"), (103, None), (104, ""), (104, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'z' as row", "1 as entities")
    got = {(r.doc_id): [tuple(e) for e in r.entities] for r in pii.find(df).collect()}
    assert [e[1] for e in got[100]] == [4] and rows[8][1][got[100][0][0] : got[100][0][2]] == "AB-12345-X"
    assert [e[1] for e in got[101]] == [4]
    assert got[102] == got[103] == got[104] == []
    assert all([e[1] for e in got[i]] == [0] for i in range(8))
    texts = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert texts[100] == "Now use contact address [CONTEXT] today" and texts[103] is None and texts[3].endswith("contact address [EMAIL] today or not")
    assert pii.redact(df).columns == df.columns and pii.redact(df).count() == len(rows)


def test_frames_of_symbols_reach_other_forms(spark):
    """Seeds are of one form, what a pattern brings in of another; the same numbers elsewhere stay, as their contexts don't recur."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    hexa = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows, keys = [], {}
    for i in range(60):
        card = "".join(r.choice("0123456789") for _ in range(15))
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        rows.append((i, f"{word()} {word()} {card} {word()} {word()}"))
    for i in range(60, 90):
        rows.append((i, f"{word()} {word()} {str(4 * 10**15 + i)[:-1]}{'1' if not pii.luhn(str(4 * 10**15 + i)[:-1] + '1') else '2'} {word()}"))
    for i in range(90, 120):
        keys[i] = hexa()
        rows.append((i, f'{word()} {word()}. Token = "{keys[i]}" {word()}'))
    rows += [(120, f"again {keys[95]} stands here"), (121, 'a token = "" or token = "word" says little'), (121, 'a token = "" or token = "word" says little')]
    got = {}
    for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(x.doc_id, []).append([(e.kind, rows[x.doc_id][1][e.start : e.end]) for e in x.entities])
    assert all(got[i] == [[(4, keys[i])]] for i in keys) and got[120] == [[(4, keys[95])]]
    assert all([k for k, _ in got[i][0]] == [2] for i in range(60))
    assert all(got[i] == [[]] for i in range(60, 90)) and got[121] == [[], []]


def test_scores_match_plain_rounds(spark):
    r = random.Random(8)
    edges = {}
    for _ in range(400):
        kind = r.choice(["seed", "plain", "id", "id"])
        v = {"seed": f"s{r.randrange(20)}@x", "plain": r.choice("abcdefg") * 3, "id": f"{r.randrange(10 ** r.choice([2, 5, 9])):03d}-x"}[kind]
        edges[(f"p{r.randrange(12)} ", v)] = kind
    prior = {k: p for k, p in zip(range(1, 6), (0.0, 0.5, 0.8, 0.2, 0.6))}
    of = lambda v: sum(c.isdigit() for c in v).bit_length() or 1
    score = {(p, v): 1.0 if k == "seed" else 0.0 if k == "plain" else prior.get(of(v), 0.0) for (p, v), k in edges.items()}
    for _ in range(pii.ROUNDS):
        sure = {}
        for p in {p for p, _ in edges}:
            mine = [score[e] for e in edges if e[0] == p]
            if sum(edges[e] != "plain" for e in edges if e[0] == p) >= pii.SUPPORT and (s := sum(mine) / (len(mine) + 1)) >= pii.PURE:
                sure[p] = s
        now = {}
        for (p, v), k in edges.items():
            if k == "id" and p in sure:
                now[v] = max(now.get(v, 0), sure[p])
        now = {v: 1 - (1 - prior.get(of(v), 0.0)) * (1 - s) for v, s in now.items()}
        score = {(p, v): now.get(v, score[p, v]) if k == "id" else score[p, v] for (p, v), k in edges.items()}
    rows = spark.createDataFrame([(p, v, k == "seed") for (p, v), k in edges.items()], "pattern string, value string, seed boolean")
    priors = spark.createDataFrame(list(prior.items()), "bucket int, prior double")
    got = {x.value: x.score for x in pii.scores(rows, priors, Scratch(spark, "test")).collect()}
    assert got.keys() == now.keys() and all(abs(got[v] - now[v]) < 1e-9 for v in now) and len(now) > 20


def test_places():
    low = 'x token = "ab-1" token = "" e-token = "9". mytoken = "8" token = "a@b.c," İ token = "7"'
    assert [(low[a:b], seed) for _, a, b, _, seed in pii.places(low, pii.automaton_of(['token = "']))] == [("ab-1", False), ("9", False), ("a@b.c", True), ("7", False)]
    assert pii.frames('say: key = "', 12) == ['key = "', 'say: key = "'] and pii.frames("key1 is ", 8) == [] and pii.frames("a\nkey is ", 9) == ["key is "]


def test_long_texts(spark):
    rows = [(1, "call 12345 " * 50_000), (2, "é" * 300_000 + " a@b.c"), (3, "1" * 200_000)]
    got = {x.doc_id: len(x.entities) for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_joined(spark):
    df = spark.createDataFrame([(1, "1.2.3.4 a@b.c")], "doc_id long, text string")
    assert pii.find(df).select(pii.joined(F.col("entities")).alias("x")).first().x == "ip:0:7,email:8:13"


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(df).count() == 0 and pii.redact(df).count() == 0


def test_copies_and_partitions_change_nothing(spark):
    """Quoted e-mails and identifiers behind one pattern, and many copies of a text with a plain word there; a pattern is judged by plain counts of its different values."""
    rows = [(i, f'set token = "u{i}@mail.example.com" here') for i in range(20)] + [(100 + i, f'set token = "AB-77{i}91-X" here') for i in range(4)]
    copies = [(1000 + i, 'set token = "word" here') for i in range(200)]
    found = []
    for parts, given in ((1, rows + copies), (7, rows + rows + copies[:1]), (200, rows + copies)):
        df = spark.createDataFrame(given, "doc_id long, text string").repartition(parts)
        out = pii.find(df).select("doc_id", F.filter("entities", lambda e: ~e["base"]).alias("e")).where("size(e) > 0").distinct().collect()
        found.append({(r.doc_id, *map(tuple, r.e)) for r in out})
    assert all(f == found[0] for f in found) and {f[0] for f in found[0]} == {100, 101, 102, 103}


def test_pure_patterns_match_plain_counts(spark):
    r = random.Random(4)
    edges = {(f"p{r.randrange(12)}", "".join(r.choice("ab1é٣") for _ in range(r.randrange(1, 4)))) for _ in range(300)}
    rows = [(p, v, r.random() < 0.1) for p, v in sorted(edges)]
    mine = {}
    for p, v, seed in rows:
        n = mine.setdefault(p, [0, 0])
        n[0] += 1
        n[1] += seed or not v.isalpha()
    want = {p for p, (n, ids) in mine.items() if ids >= pii.SUPPORT and ids >= pii.PURE * n}
    for parts in (1, 40):
        df = spark.createDataFrame(rows, "pattern string, value string, seed boolean").repartition(parts)
        assert {x[0] for x in pii.pure_patterns(df).collect()} == want


def documents(path, texts):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), path / "documents.parquet")
    return str(path)


def test_query_counts_each_kind(spark, tmp_path):
    """Several entities of a kind in a text, in any order; counts and digest are those of the plain patterns."""
    import hashlib

    from surgeline.llm.queries import op9_bootstrapped_context

    r = random.Random(5)
    parts = ["a@b.c", "x@y.z", "1.2.3.4", "10.0.0.7", "4111 1111 1111 1111", "+1 (017) 555-7713", "+4420 7946 0958", "word"]
    texts = ["a@b.c", "a@b.c x@y.z a@b.c", "+1 (017) 555-7713 and 1.2.3.4", None, ""] + [" , ".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(60)]
    want = {}
    for i, text in enumerate(texts):
        found = brute(text)
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()
        want[i] = (*[sum(e[1] == k for e in found) for k in range(4)], digest)
    got = op9_bootstrapped_context(spark, documents(tmp_path, texts)).collect()
    assert len(got) == len(texts) and {x.doc_id: (x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got} == want


def test_patterns_whose_places_are_never_filled(spark, tmp_path):
    """An e-mail that begins with a symbol fills no pattern's place, so no pattern may be left to look for."""
    from surgeline.llm.queries import op9_bootstrapped_context

    got = op9_bootstrapped_context(spark, documents(tmp_path, [f"mail me %a{i}@b.c" for i in range(9)])).collect()
    assert [(x.n_email, x.spans) for x in got] == [(1, "email:8:15")] * 9
