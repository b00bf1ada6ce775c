"""Parcel layers: responses of the two state services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlake.functions.parcel import normalise_parcels
from auctionlake.sources.feeds import read_texts

ATTRIBUTES = "parno altparno nparno cntyfips cntyname siteadd ownname parusecd2 parusedsc2 gisacres recareano".split()
FEATURES = (
    f"features array<struct<attributes:struct<{','.join(a + ':string' for a in ATTRIBUTES)}>,"
    "geometry:struct<rings:array<array<array<double>>>>>>"
)
TN_TEXT = "OWNER OWNER2 ADDRESS CITY CMAP GP PARCEL GISLINK SUBDIV LOT".split()
TN_FEATURES = (
    f"features array<struct<attributes:struct<COUNTY_ID:int,{','.join(a + ':string' for a in TN_TEXT)},"
    "DEEDAC:double,CALCAC:double>>>"
)


def parcel_features(files: DataFrame, column: str = "content", file: str = "file") -> DataFrame:
    """One row per feature with attributes; ``feature_id`` keeps the order of files and features."""
    body = F.from_json(F.col(column), FEATURES)
    rows = files.select(file, F.posexplode(body["features"]).alias("pos", "f")).where("f.attributes is not null")
    ident = F.concat_ws("#", F.col(file).cast("string"), F.lpad(F.col("pos").cast("string"), 9, "0"))
    return rows.select(ident.alias("feature_id"), "f.attributes", "f.geometry")


def read_parcels(spark: SparkSession, path: str) -> DataFrame:
    """Clean parcels of all landed responses, with those marked that have no acreage."""
    return normalise_parcels(parcel_features(read_texts(spark, path)))


def tn_parcels(files: DataFrame, column: str = "content", file: str = "file") -> DataFrame:
    """Assessment parcels, ordered by ``ord`` as the responses list them."""
    body = F.from_json(F.col(column), TN_FEATURES)
    rows = files.select(file, F.posexplode(body["features"]).alias("pos", "f"))
    return rows.select(
        F.concat_ws("#", F.col(file).cast("string"), F.lpad(F.col("pos").cast("string"), 9, "0")).alias("ord"),
        "f.attributes.*",
    )


def read_tn_parcels(spark: SparkSession, path: str) -> DataFrame:
    return tn_parcels(read_texts(spark, path))
