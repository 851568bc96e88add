"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgraph.llm import bpe, embed_dedup, hard_negatives, html_text, line_dedup, media, minhash, oracle, packing, periodic_runs, pii, quality, secret_scan, token_output
from specgraph.storage import new_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {
    "op2_minhash_near_dedup": oracle.NEAR_DUPLICATES, "op9_embedding_near_dedup": oracle.near_vectors(0.9), "base_secret_spans": oracle.BASE_SECRETS, "base_personal_data": oracle.BASE_PERSONAL_DATA,
    "near_vectors_at_040": oracle.near_vectors(0.4), "near_vectors_at_035": oracle.near_vectors(0.35),
    "op11_hard_negatives": oracle.HARD_NEGATIVES, "op12_line_dedup": oracle.LINE_DEDUP, "op13_periodic_runs": oracle.PERIODIC_RUNS,
}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: Bytes up to which a table in fewer files than there are cores is dealt out before anything else.
FEW = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table.  A row group is one task's, however many cores there are, so a small table in few files is spread first; others are read as they lie."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(4 * cores) if size < FEW and len(rows.inputFiles()) < cores else rows


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-table")
    token_output.write_token_table(table(spark, sf_dir, "documents"), path)
    return token_output.read_documents(spark, path)


@query
def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store_tiles(media.text_images(table(spark, sf_dir, "documents"))))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents"), digest=True)


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(table(spark, sf_dir, "documents")))


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def near_vectors_at_040(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op9 at a cosine that vectors of the given tables reach: links and components of some vectors."""
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.4)


@query
def near_vectors_at_035(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where most vectors have links."""
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.35)


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.drop_shared_lines(table(spark, sf_dir, "documents")))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


@query
def base_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed formats of op6's operator alone: the part of its result that SQL can express."""
    return secret_scan.digest(secret_scan.secrets(table(spark, sf_dir, "documents"))).drop("spans", "n_random")


@query
def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed formats of op10's operator alone: the part of its result that SQL can express."""
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents"))).drop("spans", "n_extra")
