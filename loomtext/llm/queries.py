"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import audit, chunks, hmm, langid, minhash, mixing, mtree, negatives, qgram, secret_scan, shards, warc, wrappers
from loomtext.llm.common import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wrapper_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(_table(spark, sf_dir, "pages"))


def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_digests(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("uri")


def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(mtree.integer_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return mtree.search(vectors, vectors.filter(F.pmod("id", F.lit(100)) == 0), 10)


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(_table(spark, sf_dir, "documents"), 8)


def op8_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), 85)


def op9_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "inclusion")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = materialise(negatives.labelled_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, 256))
    return negatives.hard_negatives(vectors, vectors.filter(F.col("id") % 100 == 0))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.PATTERNS))
    confirmed = F.size("secrets").cast("long") - F.size(base).cast("long")
    return found.select("doc_id", *map(number, secret_scan.PATTERNS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"), confirmed.alias("n_confirmed"))


QUERIES = {f.__name__: f for f in (op1_wrapper_texts, op2_chunk_dedup, op3_warc_transactions, op4_hmm_scores, op5_language_id, op6_mtree_topk, op7_byte_shards, op8_minhash_components, op9_qgram_decontamination, op10_pareto_mix, op11_hard_negatives, op12_filter_audit, op13_secret_scan)}
