"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, cmlm, decontam, fim, htmlmain, langid, mixing, sharding, simhash, sufdedup, topk, toxicity, vafile
from .common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmlm.score_documents(table(spark, sf_dir, "documents"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_text(table(spark, sf_dir, "pages"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sufdedup.dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


def op12_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.with_label_errors(vafile.compress(table(spark, sf_dir, "embeddings"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_langid, op2_lm, op3_decontam, op4_sharding, op5_ann, op6_html, op7_suffix, op8_mixing, op9_toxicity, op10_simhash, op11_topk, op12_vafile, op13_fim)}
ORACLE_SQL: dict[str, str] = {"op7_suffix": sufdedup.ORACLE, "op8_mixing": mixing.ORACLE, "op11_topk": topk.ORACLE, "op12_vafile": vafile.oracle(), "op13_fim": fim.ORACLE}
