import random
import zlib
from collections import defaultdict

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surgeline.llm import pii
from tests.llm import test_decontaminate, test_jaccard, test_quality_rules


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def text(i, n=40):
    return " ".join(f"word{i}x{k}" for k in range(n))


def test_stages_keep_columns_and_decide(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    rows = [(3, text(1), "en", "s", 1), (1, text(1), "en", "s", 1), (None, text(1), "en", "s", 1), (2, text(2), None, None, None), (2, text(2), None, None, None), (5, None, "en", "s", 0), (5, None, "en", "s", 0), (6, "", None, "s", 0), (7, text(7) + " " + bench, "en", "s", 9), (8, "Write to a.b@c.de now", "en", "s", 5)]
    docs = docs_of(spark, rows)
    near = P.near_duplicate_stage(spark, docs, sf_dir)
    assert near.columns == docs.columns
    assert sorted((r.doc_id for r in near.collect()), key=str) == [1, 2, 5, 5, 6, 7, 8]
    clean = P.benchmark_stage(spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 1 and clean.where("doc_id = 7").count() == 0
    private = P.personal_data_stage(spark, docs, sf_dir)
    got = private.where("doc_id = 8").first()
    assert private.columns == docs.columns and private.count() == len(rows) and got.text == "Write to [EMAIL] now" and got.n_chars == len(got.text)
    kept = P.rule_stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns and set(r.doc_id for r in kept.collect()) <= {1, 2, 3, 7, None}
    odd = docs.withColumn("row_", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("id", F.lit(3))
    for stage in (P.near_duplicate_stage, P.benchmark_stage, P.personal_data_stage, P.rule_stage):
        assert stage(spark, odd, sf_dir).columns == odd.columns
        assert stage(spark, odd.limit(0), sf_dir).count() == 0


def fixture(spark, folder):
    """A small corpus with every case that a stage decides on, and its tables."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(k, say(30)) for k in range(3)]
    rows = [(i, say(r.choice([8, 40, 90]))) for i in range(0, 60)]
    for i in range(60, 80):  # near copies
        w = r.choice(rows[:60])[1].split()
        w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(80 + k, say(20) + " " + items[k][1] + " " + say(25)) for k in range(3)]
    rows += [(90 + k, say(20) + f" x{k}.y@mail.example.com " + say(20) + " +1 (017) 555-7713 " + say(9)) for k in range(6)]
    rows += [(100 + k, f"%%% ### {k} $$$ !!! " * 30 + say(25)) for k in range(4)] + [(110, "word word two " * 60), (111, None), (112, ""), (113, say(6000)), (20, rows[20][1]), (None, say(50))]
    r.shuffle(rows)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in range(0, 104)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return items


def test_run_matches_plain_stages(spark, tmp_path):
    """The whole pipeline against each stage's decisions made one document at a time."""
    folder = "file://" + str(tmp_path)
    items = fixture(spark, folder)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    # 1: word measures, and the mean log ratio of hashed tokens and pairs of them
    from surgeline.llm import quality_rules as Q

    tokens = spark.createDataFrame([(t or "",) for _, t in docs], "t string").select(Q.token_hashes("t").alias("h"))
    cells = [x[0] for x in tokens.select(Q.buckets(F.col("h"))).collect()]
    n, t = np.ones(Q.BUCKETS), np.ones(Q.BUCKETS)
    for (i, _), c in zip(docs, cells):
        np.add.at(n, c, 1)
        if i is not None and i < 100:
            np.add.at(t, c, 1)
    ratio = np.log(t / t.sum()) - np.log(n / n.sum())
    kept = [(i, x) for (i, x), c in zip(docs, cells) if not test_quality_rules.brute(x)[-1] and (ratio[c].mean() if c else 0.0) >= Q.THRESHOLD]
    assert 0 < len(kept) < len(docs)
    # 2: one of each group, the smallest id, and a null id last
    named = [(k if i is None else i, x) for k, (i, x) in zip(range(10**6, 10**7), kept)]
    stay, seen = [], set()
    for (d, _, least), (i, x) in zip(sorted(test_jaccard.brute(named, 5, 80, 100), key=str), sorted(named, key=lambda p: str((p[0], 0)))):
        if d == least and d not in seen:
            seen.add(d)
    for i, x in sorted(named, key=lambda p: p[0]):
        if i in seen and not any(i == j for j, _ in stay):
            stay.append((i, x))
    assert len(stay) < len(kept)
    # 3 and 4: no window of an item, and entities give way
    clean = [(i, x) for i, x in stay if test_decontaminate.brute([(i, x)], items)[0][2] == 0]
    assert len(clean) < len(stay)
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, x in clean:
        for a, k, b in sorted(pii.base_entities(x), reverse=True):
            x = x[:a] + f"[{pii.KINDS[k].upper()}]" + x[b:]
        ids = np.array([*tok.encode(x, add_special_tokens=False).ids, 0], "<u4")
        i = None if i >= 10**6 else i
        want += [(i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    # 5: every document that is left once, gapless, in as few sequences as the sum asks for
    out = P.run(spark, folder).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, size in sorted(places):
            assert o == at
            at += size
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in out) // 2048)
    assert [n for n, _ in P.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
