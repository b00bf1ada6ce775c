"""The registered queries of this subpackage: name -> (callable of session and data folder, reference SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, langid, licenses, minhash, packing, periodic, quality, scoring, sharding, tokenfiles, urls, variants
from .common import table
from .subwords import vocabulary


def op1_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"), vocabulary())


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.keyed(sharding.shard(table(spark, sf_dir, "documents"), 40), "shard", "slot")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = tokenfiles.round_trip(spark, table(spark, sf_dir, "documents"), vocabulary(), end_id=1)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=2))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "similarity")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents"), damage=199)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(periodic.with_loops(table(spark, sf_dir, "documents"))))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_scoring": (op1_scoring, None),
    "op2_minhash": (op2_minhash, None),
    "op3_sharding": (op3_sharding, None),
    "op4_urls": (op4_urls, None),
    "op5_token_files": (op5_token_files, None),
    "op6_language": (op6_language, None),
    "op7_embeddings": (op7_embeddings, None),
    "op8_licenses": (op8_licenses, licenses.SQL),
    "op9_packing": (op9_packing, None),
    "op10_decontamination": (op10_decontamination, decontaminate.SQL),
    "op11_variants": (op11_variants, None),
    "op12_periodic": (op12_periodic, None),
    "op13_quality": (op13_quality, quality.SQL),
}
