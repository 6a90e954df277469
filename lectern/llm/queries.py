"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, binpack, fim, hostrep, mixing, ngram, quality, simhash, sitetree, tokenorc, topk, variants, warc
from lectern.llm.common import crc_remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, query_step=50, scale=256)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, query_step=50)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(table(spark, sf_dir, "documents"), crc_remainder(F.col("doc_id"), 7) == 2)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return out.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3.0)


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # A page's outcome is the label of the document that it shows, whose number is in its path.
    _, path = hostrep.host_and_path(F.col("url"))
    shown = pages.select("page_id", F.regexp_extract(path, r"/([0-9]+)", 1).try_cast("long").alias("doc_id")).where("page_id IS NOT NULL AND doc_id IS NOT NULL")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return hostrep.judge(pages, shown.join(labels, "doc_id").select("page_id", bad))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out, threshold=0.3)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents"), rate=50, spm_rate=80, seed=42))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"), one_in=199, least_chars=6, least_count=5, times=5)


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenorc.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_ann": op2_ann,
    "op3_lm": op3_lm,
    "op4_html": op4_html,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_host_reputation": op7_host_reputation,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_fim": op11_fim,
    "op12_variants": op12_variants,
    "op13_token_ids": op13_token_ids,
}

ORACLES: dict[str, str] = {"op1_topk": topk.ORACLE, "op6_mixing": mixing.ORACLE, "op7_host_reputation": hostrep.ORACLE, "op8_warc": warc.ORACLE, "op11_fim": fim.ORACLE, "op12_variants": variants.ORACLE}
