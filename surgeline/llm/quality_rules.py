"""Quality rules: text measures, and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over BUCKETS hashed unigrams and bigrams are counted: one over
all documents, one over the documents that are trusted. A document's score is
the mean over its n-grams of log(trusted share / corpus share), so long and short
texts compare. Every document whose score is under THRESHOLD goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgeline.llm.shared import maybe_broadcast, whole_row

#: Cells of the hashed n-grams (a power of 2); this bounds what reaches the driver.
BUCKETS = 1 << 14
#: Least mean log ratio of a document that stays.
THRESHOLD = -0.25
#: Trusted ids up to which they are broadcast (about 40 bytes each).
BROADCAST_IDS = 1_000_000

SPACES = r"\x20\x09-\x0D"
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"
WINDOW = 8


def measures(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to a table with a column body (no nulls)."""
    has_word = lambda x: x.rlike(f"[^{SPACES}]")
    lines = F.filter(F.split("body", "\n", -1), has_word)
    df = df.withColumn("words_", F.regexp_extract_all("body", F.lit(f"[^{SPACES}]+"), F.lit(0))).withColumn("lines_", lines)
    df = df.select(
        "*", F.size("words_").cast("long").alias("n_words"), F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"), F.transform("words_", lambda x: F.xxhash64(x)).alias("hash_"),
    ).drop("words_", "lines_")
    h, last = F.col("hash_"), F.size("hash_") - WINDOW
    df = df.withColumn("grams_", F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)])))
    # only texts with a repeated window are sorted
    again = F.size(F.array_distinct("grams_")) < F.size("grams_")
    sorted_ = F.sort_array(F.transform(F.when(again, F.col("grams_")).otherwise(F.array().cast("array<long>")), lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    df = df.withColumn("sorted_", sorted_).drop("hash_", "grams_")
    s = F.col("sorted_")
    same = lambda e, i: (e["g"] == F.get(s, i + 1)["g"]) | (F.when(i > 0, F.get(s, i - 1)["g"]) == e["g"])
    at = F.sort_array(F.transform(F.filter("sorted_", lambda e, i: F.coalesce(same(e, i), F.lit(False))), lambda e: e["i"]))
    df = df.withColumn("at_", at).drop("sorted_")
    covered = F.transform(F.col("at_"), lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at_"), i + 1) - x, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long")).drop("at_")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def buckets(hashes: Column) -> Column:
    """Cells of all unigrams and bigrams of a text, from the hashes of its tokens."""
    pairs = F.transform(F.when(F.size(hashes) > 1, F.sequence(F.lit(0), F.size(hashes) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)))
    return F.transform(F.concat(hashes, pairs), lambda x: x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))


def token_hashes(text: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(trusted share / corpus share) of each cell, over all of docs (id, body); trusted has the ids (id) of trusted documents. Add-one smoothing."""
    marks = trusted.select(F.col("id").alias("tid")).where("tid is not null").distinct().withColumn("t", F.lit(1))
    marks = maybe_broadcast(marks, BROADCAST_IDS)
    rows = docs.select("id", token_hashes("body").alias("h")).join(marks, F.col("id") == F.col("tid"), "left").select(F.coalesce("t", F.lit(0)).alias("t"), "h")
    counts = rows.select("t", F.explode(buckets(F.col("h"))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"), F.sum("t").alias("t")).collect()  # at most BUCKETS rows
    n, t = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        n[r["cell"]] += r["n"]
        t[r["cell"]] += r["t"]
    if sum(t) == BUCKETS:  # nothing is trusted, so nothing is judged
        return [0.0] * BUCKETS
    import math

    total_n, total_t = sum(n), sum(t)
    return [math.log(a / total_t) - math.log(b / total_n) for a, b in zip(t, n)]


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judges every document by its measures and by its likeness to trusted documents.

    docs (id, text); trusted (id): ids of documents of the trusted target.
    Returns one row for each row of docs: doc (the row itself), id, text, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, score, kept. Words are runs of
    anything but ASCII white space.
    Null or empty texts have no words: they fail the base rules. A text without
    n-grams scores 0. Repeated rows have equal results; a null id is never
    trusted; trusted ids that are in no document do nothing. Without any trusted
    document every score is 0, and the base rules alone decide. A score equal to
    the threshold stays. Other columns only go along in doc.
    """
    docs = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    table = F.expr("cast(split('" + ",".join(repr(round(x, 6)) for x in log_ratios(docs, trusted)) + "', ',') as array<double>)")
    out = measures(docs).withColumn("h_", token_hashes("body"))
    out = out.withColumn("cells_", buckets(F.col("h_")))
    score = F.aggregate("cells_", F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.greatest(F.size("cells_"), F.lit(1))
    out = out.withColumn("score", score)
    return out.select("doc", F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))


def kept_rows(judged: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep.

    They go through a generator, as a filter would be pushed down and have every
    measure put into it, again and again for each use.
    """
    return judged.select(F.explode(F.when(F.col("kept"), F.array("doc")).otherwise(F.slice(F.array("doc"), 1, 0))).alias("doc")).select("doc.*")
