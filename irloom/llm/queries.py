"""The registered queries of the training-data operators: op<N>_<name>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.llm import bpe, codes, langid, licenses, merkle, minhash, ngram, packing, quality, sql, topk, toxicity, vectors, warc
from irloom.llm.common import crc_mod, discard, read, shared_dir


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram.scores(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "confirmed")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), digest=True)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3) == 1
    model = quality.fit(docs, read(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codes.compress(read(spark, sf_dir, "embeddings"))
    of_length = F.lit(None).cast("string")
    for dim, book in books.items():  # one length as a rule
        of_length = F.when(F.col("dim") == dim, codes.book_digest(book)).otherwise(of_length)
    return rows.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", of_length.alias("codebooks_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = merkle.row_leaves(read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3) == 0)
    return merkle.manifest(leaves).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    read_back = warc.round_trip(read(spark, sf_dir, "pages"), folder)
    discard(spark, folder)  # what was read back is kept as a table
    return read_back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_licenses, op3_byte_bpe, op4_quality, op5_topk, op6_language_id, op7_minhash, op8_vectors, op9_toxicity, op10_packing, op11_vector_codes, op12_merkle_manifest, op13_warc)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
