"""Ordinary tables read as spectra: an index of records with a mass, and their peaks in long form.

========  =====================  ============================  ==================================
mapping   record                 peak (m/z, intensity)         mass, charge
========  =====================  ============================  ==================================
vectors   embeddings.vec_id      100 + 10 * dim, |component|   400 + (vec_id % 97) * 0.37
parts     part.p_partkey         l_quantity, l_extendedprice   p_retailprice, 1 + p_size % 3
users     events.user_id         value, event_id % 1000 + 1    400 + (user_id % 40) * 0.5
========  =====================  ============================  ==================================

Masses are FLOAT in every mapping: the tolerance test is done in that type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_quantity").cast("float").alias("mz"), F.col("l_extendedprice").cast("double").alias("intensity"))


def part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("node_id"), F.col("p_retailprice").cast("float").alias("mass"), (1 + F.col("p_size") % 3).cast("int").alias("charge"), F.concat(F.lit("f"), (key % 5).cast("string")).alias("file_stem"), key.alias("native_id")
    )


def part_identifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of identifications for the same scans, some with modifications; the second repeats a third of them with another name."""
    key = F.col("p_partkey")
    first = read(spark, sf_dir, "part").select(
        F.concat(F.lit("f"), (key % 5).cast("string")).alias("ms_file"), key.alias("native_id"), F.col("p_brand").alias("peptide"), (1 + F.col("p_size") % 3).cast("int").alias("charge"),
        ((key * 37) % 1000 / 1000.0).alias("probability"), (key % 13 == 0).alias("is_decoy"), F.lit(0).alias("iden_file_id"), key.alias("position"),
        F.when(key % 4 == 0, F.array(F.struct((1 + key % 3).cast("int").alias("pos"), (F.lit(100.5) + key % 2).alias("mass")))).otherwise(F.array().cast("array<struct<pos:int,mass:double>>")).alias("mods"),
        F.when(key % 6 == 0, 43.5).alias("nterm_mod"), F.when(key % 10 == 0, 17.25).alias("cterm_mod"),
    )
    second = first.where("native_id % 3 = 0").withColumns({"peptide": F.concat("peptide", F.lit("x")), "iden_file_id": F.lit(1), "position": F.col("position") + 1})
    return first.unionByName(second)


def user_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.col("value").cast("float").alias("mz"), (F.col("event_id") % 1000 + 1).cast("double").alias("intensity"))


def user_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("node_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("node_id")).distinct().select(
        "node_id", (400 + (key % 40) * 0.5).cast("float").alias("mass"), (1 + key % 3).cast("int").alias("charge"), F.concat(F.lit("u"), (key % 4).cast("string")).alias("file_stem"), key.alias("native_id")
    )


def vector_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.posexplode("embedding").alias("dim", "x")).select(
        "node_id", (100 + 10 * F.col("dim")).cast("float").alias("mz"), F.abs("x").cast("double").alias("intensity")
    )


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        key.alias("node_id"), (400 + (key % 97) * 0.37).cast("float").alias("mass"), (1 + F.col("label") % 4).cast("int").alias("charge"), F.concat(F.lit("e"), F.col("label").cast("string")).alias("file_stem"), key.alias("native_id")
    )
