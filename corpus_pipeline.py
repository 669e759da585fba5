"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, mixing, sharding, simhash, toxicity
from quillon.llm.common import fresh_path, table, temp_name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier scores as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages up to the coverage limit go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    (mark,) = temp_name(docs, "mix_copies")
    return mixing.emit(mixing.mix(docs, prefix=mark.removesuffix("copies")), mark).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard (0 to 23) and its virtual slot.

    Copies of a document that the mix took several times share a slot.
    """
    keys = [F.col("doc_id"), sharding.text_crc(F.col("text"))]
    slot_map = sharding.build_map(docs, keys, sharding.record_bytes(F.col("text")), 24)
    return sharding.place(docs, keys, slot_map).select(*docs.columns, "shard", "virtual_slot")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Trained models and fingerprints of XXH64 are beyond SQL; tests/llm hold every stage against a version by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
