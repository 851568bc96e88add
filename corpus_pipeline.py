"""A training corpus from raw documents: quality, near-duplicates, personal data, packing.

Every stage takes the documents that the one before kept.  All but the last return
the columns of ``documents``; the last returns the packed pieces.  Empty tables give empty
results in every stage, and further columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgraph.llm import minhash, packing, pii, quality
from specgraph.storage import new_path, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer trained on weak labels doesn't reject.

    Null, empty and wordless texts stay; rows are decided one by one, so repeated ids and copies don't matter; a probability of
    exactly one half rejects.
    """
    return quality.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest id: five-word shingles, similarity 0.8.

    Texts that are null, empty or without words stay, and so do rows without an id.  Rows that share an id are one
    document (their words together): all of them stay, or none.
    """
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind; n_chars follows the text.

    Null texts stay null and keep their n_chars; repeated rows are treated one by one.
    """
    out = pii.redact(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens.

    A null or empty text is one piece of its end token; repeated rows and ids are packed row by row.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("PII", pii_redaction),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no trained models, no tokenizer and no packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.lower().replace(" ", "-"))
        with scratch():  # what a stage writes for itself goes when its output is there
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
