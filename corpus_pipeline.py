"""A corpus pipeline over documents: rules, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgeline.llm.decontaminate import contamination
from surgeline.llm.jaccard import jaccard_components
from surgeline.llm.packing import pack
from surgeline.llm.pii import redact
from surgeline.llm.quality_rules import kept_rows, quality_rules
from surgeline.llm.shared import Scratch, maybe_broadcast, owned


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; labels name the trusted ones.

    Null and empty texts have too few words, so they go. Repeated rows have equal
    results, all of them stay or go. A null id is never trusted. An empty table gives
    none. Long texts are judged whole; other columns go along, whatever their names.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id"))
    return kept_rows(quality_rules(docs, trusted))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles with a similarity of 0.8 or more, the document with the smallest id stays.

    A null id comes last; of rows with one id and text, or of ids that tie, one stays.
    Null and empty texts are like nothing, so all of them stay, repeated rows included.
    An empty table gives none. Long texts are compared whole; other columns go along.
    """
    scratch = Scratch(spark, "near-duplicates")
    columns = docs.columns
    key = "key_"
    while key in columns:
        key += "_"
    # ids may repeat or be null; the smallest id comes first
    docs = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")))
    groups = jaccard_components(docs, words=5, num=80, den=100, id_col=key)
    groups = scratch.table(groups.where("n_shingles > 0").groupBy(F.col(key).alias("k")).agg(F.first("component_id").alias("c"), F.count("*").alias("n")))
    gone = scratch.table(groups.where("k <> c").select(F.col("k").alias(key)))
    again = scratch.table(groups.where("k = c and n > 1").select(F.col("k").alias(key)))
    kept = docs.join(maybe_broadcast(gone, 500_000), key, "left_anti")
    alone, same = kept.join(maybe_broadcast(again, 500_000), key, "left_anti"), kept.join(maybe_broadcast(again, 500_000), key, "left_semi")
    return alone.union(same.select(alone.columns).dropDuplicates([key])).select(*[F.col(f"`{c}`") for c in columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go.

    Null and empty texts stay. Repeated rows have equal results. Empty tables give
    none, or all of docs. Long texts are searched whole; other columns go along.
    """
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select("doc.*")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind, and n_chars follows.

    Every row stays. A null text stays null, with a null n_chars; an empty one stays
    empty. Repeated rows have equal results. An empty table gives none. Long texts are
    searched whole; other columns go along.
    """
    out = redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048.

    Every row is packed once, repeated rows and null ids too; null and empty texts are
    one token. An empty table gives none. Long texts are cut into pieces; other columns
    aren't read.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", rule_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("PII", personal_data_stage),
    ("best-fit packing", packing_stage),
]

#: The packing stage can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with owned():
            done = scratch.table(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
