"""From raw documents to packed training sequences: language ID, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir); ``docs`` is what its predecessor kept, read back from Parquet. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auctionlake.llm import decontaminate, langid, minhash, packing
from auctionlake.llm.common import staged, table, text_key
from auctionlake.llm.subwords import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; those without text or letters, or whose score is below that of labelled rows, go. Rows that
    repeat and rows without an id are treated alike; without labelled rows nothing is recognised; no rows give no rows. Texts are
    read whole; other columns pass through."""
    return langid.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, Jaccard similarity 0.8): that of least id, those without an id last.

    Rows are told apart by 128 bits of id and text: other texts under the same id, and other rows without one, are documents of
    their own. Of rows that repeat an id and a text one stays. Texts without words are near to nothing and stay.
    """
    groups = minhash.near_duplicates(docs, width=5, percent=80, bands=36, rows=5)
    keep = groups.where("first").select(F.col("row_key").alias(KEY)).distinct()
    keyed = docs.withColumn(KEY, text_key(docs["doc_id"].cast("bigint"), docs["text"].cast("string")))
    turn = F.row_number().over(Window.partitionBy(KEY).orderBy(KEY))
    return keyed.join(keep, KEY, "left_semi").withColumn(TURN, turn).where(F.col(TURN) == 1).select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; those without text or words hold none and stay. Rows that repeat are treated
    alike; an empty side changes nothing; ids may be null or repeat (128 bits of id and text name a row)."""
    return decontaminate.clean(docs, decontaminate.matches(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4,096 ids. A null text is packed as an empty one, whose end id alone is laid;
    repeated rows are packed as often; long texts are cut; other columns are not read; no rows give no pieces."""
    return packing.digest(packing.pack(docs, vocabulary(), end_id=2))


#: Helper columns of ``near_dedup``, named so that no input is likely to hold them.
KEY, TURN = "_near_dedup_key", "_near_dedup_turn"

STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: Trained models and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
