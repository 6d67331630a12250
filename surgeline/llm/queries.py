"""Queries of the training-data operators, with their production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgeline.llm.oracle import ARCHIVES, CENTROIDS, CONTAMINATION, FILL_MIDDLE, NEAR_DUPLICATES
from surgeline.llm.shared import Scratch, held_out


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rules of the url filter: the longest that fits wins.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surgeline.llm.urls import judge

    return judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surgeline.llm.decontaminate import contamination

    out = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from surgeline.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surgeline.llm.suffix import remove_repeats

    out = remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_bayes_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surgeline.llm.quality_model import classify

    labels = _read(spark, sf_dir, "labels").where(~held_out("doc_id")).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    out = classify(_read(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surgeline.llm.quality_rules import quality_rules

    trusted = _read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return quality_rules(_read(spark, sf_dir, "documents"), trusted).drop("doc", "text")


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surgeline.llm.sentences import remove_spans

    return remove_spans(_read(spark, sf_dir, "documents"))


def op8_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surgeline.llm.language import identify

    docs = _read(spark, sf_dir, "documents")
    out = identify(docs, docs.where(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "text", "lang"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_bootstrapped_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surgeline.llm.pii import KINDS, find, joined

    out = find(_read(spark, sf_dir, "documents"))
    base = F.filter("entities", lambda e: e["base"])
    of = lambda k: lambda e: e["kind"] == k  # noqa: E731  Spark gives a lambda's second parameter the place in the array
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("entities")).alias("spans"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surgeline.llm.jaccard import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op11_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surgeline.llm.warc import payloads, read_archives, write_archives

    path = Scratch(spark, "archives").place()
    write_archives(_read(spark, sf_dir, "pages"), path)
    return payloads(read_archives(spark, path)).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surgeline.llm.fill_middle import rearrange, restored

    out = rearrange(_read(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (text, "restored_sha256"))])


def op13_elkan_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from surgeline.llm.centroids import cluster

    out = cluster(_read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))


QUERIES = {
    "op1_link_graph": op1_link_graph,
    "op2_winnowing": op2_winnowing,
    "op3_grouping_genetic": op3_grouping_genetic,
    "op4_suffix_array": op4_suffix_array,
    "op5_bayes_support_vectors": op5_bayes_support_vectors,
    "op6_ngram_ratio": op6_ngram_ratio,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_random_field": op8_random_field,
    "op9_bootstrapped_context": op9_bootstrapped_context,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_warc_chain": op11_warc_chain,
    "op12_fill_middle": op12_fill_middle,
    "op13_elkan_centroids": op13_elkan_centroids,
}

ORACLE_SQL: dict[str, str] = {"op2_winnowing": CONTAMINATION, "op10_ngram_jaccard": NEAR_DUPLICATES, "op11_warc_chain": ARCHIVES, "op12_fill_middle": FILL_MIDDLE, "op13_elkan_centroids": CENTROIDS}
