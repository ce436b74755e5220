"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_extract, kd_sharding, lexical, mixing, orchard, packing, quality, secret_scan, simhash_dedup, token_store, toxicity, winnowing
from .common import materialize, read
from .labels import remainder


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = kd_sharding.kd_shards(read(spark, sf_dir, "documents"), shards=16)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), bits=3)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["ord"] == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2("base_told", 256).alias("base_sha256"), F.col("told").alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    grammar = toxicity.train(docs, read(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = docs.select("doc_id", (remainder(5) == 0).alias("held_out"), toxicity.scores(grammar)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_token_files(read(spark, sf_dir, "documents"))
    return token_store.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.stored_pieces(read(spark, sf_dir, "documents"))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")  # the ids themselves need not move
    return packing.place(digests)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("bytes"))  # the order needs no texts
    mixed = mixing.mix(materialize(rows, "sizes"), size=F.col("bytes"))
    return mixed.select("doc.doc_id", "doc.source", "block", "place", "release", "deadline", "slot")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), remainder(4) != 2)
    scored = docs.select("doc_id", (remainder(4) == 2).alias("held_out"), quality.scores(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edits(read(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.clusters(read(spark, sf_dir, "embeddings"), k=8, rounds=10)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_kd_sharding, op3_simhash_near_dedup, op4_secret_scan, op5_toxicity,
        op6_token_files, op7_best_fit_packing, op8_source_mixing, op9_quality_classifier, op10_document_fingerprints,
        op11_centroid_clustering, op12_html_extraction, op13_ranked_lexical_search,
    )
}

ORACLES: dict[str, str] = {"op11_centroid_clustering": orchard.sql(), "op13_ranked_lexical_search": lexical.sql()}
