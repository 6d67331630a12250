"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window of an item is LENGTH consecutive words, or the whole of a shorter item.
Of the K-word hashes in a window, the least is its fingerprint, so equal windows
have equal fingerprints wherever they stand: any shared window shows up in the
join of document and item fingerprints. Each hit is then extended to the windows
around it, which are compared word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgeline.llm.shared import Scratch, maybe_broadcast, whole_row

#: Words of a window, and of the n-grams hashed in it.
LENGTH, GRAM = 10, 5
#: Item windows up to which they are broadcast (about 100 bytes each).
BROADCAST_WINDOWS = 300_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digits, letters and all beyond ASCII, said by what they are: three times as fast as by what they aren't.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words_of(text: str) -> Column:
    """Words of a text, A-Z lower-cased and other letters as they are; null: none. (A-Z are word letters, as the case is folded after the split.)"""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = F.octet_length(t) == F.length(t)
    folded = F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))
    return F.when(plain, F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0))).otherwise(folded)


def loose(x: Column) -> Column:
    """All letters of a text or word lower-cased, whatever stands around them (a capital sigma has two small forms). Equal words stay equal, and no word falls apart or grows together."""
    return F.lower(F.replace(x, F.lit("Σ"), F.lit("σ")))


def loose_words(text: str) -> Column:
    """Words to take fingerprints of: those of words_of, more of them equal, found without a look at each word."""
    return F.regexp_extract_all(loose(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def count_words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def _range(n: Column) -> Column:
    """0 .. n - 1; empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def grams(words: Column, k: int) -> Column:
    """The hash of each k consecutive words."""
    return F.transform(_range(F.size(words) - (k - 1)), lambda i: F.xxhash64(*[_at(words, i + j) for j in range(k)]))


def winnowed(hashes: Column, w: int) -> Column:
    """Distinct minima of each w consecutive hashes."""
    if w == 1:
        return F.array_distinct(hashes)
    return F.array_distinct(F.transform(_range(F.size(hashes) - (w - 1)), lambda i: F.least(*[_at(hashes, i + j) for j in range(w)])))


def shape(length: int) -> tuple[int, int]:
    """Words of a gram, and grams of a window, for windows of so many words."""
    k = min(GRAM, length)
    return k, length - k + 1


def windows(items: DataFrame) -> DataFrame:
    """(item_id, words) to (item_id, len, win): each item's distinct windows."""
    n = F.size("words")
    length = F.least(n, F.lit(LENGTH))
    return items.where(n > 0).select("item_id", length.alias("len"), F.explode(F.array_distinct(F.transform(_range(n - length + 1), lambda i: F.slice("words", i + 1, length)))).alias("win"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which benchmark items stand in which documents, and how many words they cover.

    docs (id, text), benchmark (item_id, text). Returns one row for each document
    row: doc (the row itself), id, n_words, n_hit (words inside any occurrence of an item window),
    n_items, items (sorted item ids as strings), spans (array of start, end word
    positions of the covered stretches, end exclusive), contaminated.
    Null and empty texts have no words and are clean; items without words match
    nothing; a null item_id counts as an item but has no place in the list;
    repeated rows have equal results; repeated items count once each by id.
    Empty tables give no rows, or clean documents. Other columns only go along in doc.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    docs = docs.select(whole_row(docs), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    # equal items form one class, so that copies of an item aren't matched again and again
    items = benchmark.select("item_id", words_of("text").alias("words")).where(F.size("words") > 0)
    wins = scratch.table(windows(items.select("words").distinct().select(F.xxhash64("words").alias("item_id"), "words")).withColumnRenamed("item_id", "class"))
    classes = scratch.table(items.select(F.xxhash64("words").alias("class"), F.col("item_id").cast("string").alias("item")).distinct())
    lengths = sorted(r[0] for r in wins.select("len").distinct().collect())  # of at most LENGTH values
    if not lengths:
        return docs.select("doc", F.col("id").alias(id_col), count_words("text").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(False).alias("contaminated"))
    split = docs.select("id", "th", loose_words("text").alias("words"))
    # hashes of K words, once for each gram size that a window length asks for
    sizes = sorted({shape(n)[0] for n in lengths})
    split = split.select("id", "th", *[grams(F.col("words"), k).alias(f"g{k}") for k in sizes])
    prints = reduce(DataFrame.union, [
        split.select("id", "th", F.lit(n).alias("len"), F.explode(winnowed(F.col(f"g{shape(n)[0]}"), shape(n)[1])).alias("print")) for n in lengths
    ])
    own = wins.select("len", "win", "class")
    own_prints = reduce(DataFrame.union, [
        own.where(F.col("len") == n).select("len", F.explode(winnowed(grams(F.transform("win", loose), shape(n)[0]), shape(n)[1])).alias("print")) for n in lengths
    ]).distinct()
    hits = scratch.table(prints.join(maybe_broadcast(own_prints, BROADCAST_WINDOWS), ["len", "print"]).groupBy("id", "th").agg(F.collect_set(F.struct("len", "print")).alias("prints")))
    # each hit is extended to the windows that have it as their fingerprint
    # only texts with hits go further
    same_row = [F.col("id").eqNullSafe(F.col("hid")), F.col("th") == F.col("hth")]
    hits = hits.select(F.col("id").alias("hid"), F.col("th").alias("hth"), "prints")
    found = docs.select("id", "th", "text").join(maybe_broadcast(hits.select("hid", "hth"), BROADCAST_WINDOWS), same_row, "left_semi").dropDuplicates(["id", "th"])
    found = found.join(hits, same_row).select("id", "th", words_of("text").alias("words"), "prints")
    found = found.withColumn("folded", F.transform("words", loose))
    n_words = F.size("words")
    places = []
    for n in lengths:
        k, w = shape(n)
        g = grams(F.col("folded"), k)
        part = found.where(F.exists("prints", lambda p: p["len"] == n)).select("id", "th", "words", F.map_from_entries(F.transform(F.filter("prints", lambda p: p["len"] == n), lambda p: F.struct(p["print"], F.lit(True)))).alias("of"), g.alias("g"))
        least = lambda i: F.least(*[_at(F.col("g"), i + j) for j in range(w)]) if w > 1 else _at(F.col("g"), i)
        part = part.select("id", "th", "words", F.explode(F.filter(_range(n_words - (n - 1)), lambda i: F.map_contains_key("of", least(i)))).alias("at"))
        places.append(part.select("id", "th", F.lit(n).alias("len"), F.col("at"), F.slice("words", F.col("at") + 1, n).alias("win")))
    places = reduce(DataFrame.union, places)
    same = scratch.table(places.join(maybe_broadcast(own, BROADCAST_WINDOWS), ["len", "win"]).groupBy("id", "th", "len", "at").agg(F.collect_set("class").alias("classes")))
    # covered words: windows in order of their starts, each adding what the ones before it don't reach
    merged = lambda a, x: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["start"]),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(a, F.array(x)))
    spans = same.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("len")).alias("end")))).alias("s"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = spans.select("id", "th", F.aggregate("s", none, merged).alias("spans"))
    listed = same.select("id", "th", F.explode("classes").alias("class")).distinct().join(classes, "class").groupBy("id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"), F.count_distinct(F.struct("item")).alias("n_items"))
    got = spans.join(listed, [spans.id.eqNullSafe(listed.id), spans.th == listed.th]).select(spans.id.alias("hid"), spans.th.alias("hth"), "spans", "items", "n_items")
    out = docs.select("doc", "id", "th", count_words("text").alias("n_words"))
    out = out.join(maybe_broadcast(scratch.table(got), 20_000), same_row, "left")
    n_hit = F.aggregate(F.coalesce("spans", none), F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long")
    return out.select(
        "doc", F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"), (n_hit > 0).alias("contaminated"),
    )
