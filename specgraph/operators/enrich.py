"""Identifications joined to clusters, their histograms, and entropies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specgraph.functions.peptides import histogram_text, identity, with_integer_masses


MODIFICATIONS = {"mods": "array<struct<pos:int,mass:double>>", "nterm_mod": "double", "cterm_mod": "double"}


def filter_identifications(idens: DataFrame, threshold: float = 0.9, include_decoy: bool = False) -> DataFrame:
    kept = idens.where(F.col("probability") >= threshold)
    return kept if include_decoy else kept.where(~F.col("is_decoy"))


def dedup_identifications(idens: DataFrame) -> DataFrame:
    """One identification for each scan: of files the lowest id, inside a file the last position."""
    order = F.row_number().over(W.partitionBy("ms_file", "native_id").orderBy("iden_file_id", F.desc("position")))
    return idens.withColumn("rn", order).where("rn = 1").drop("rn")


def identified(index: DataFrame, idens: DataFrame, keep_decoys: bool = False) -> DataFrame:
    """Records of ``index`` with peptide, modifications, iden_charge and probability of their scan, null where there is none.

    Columns of modifications that ``idens`` doesn't have are null.  Spark broadcasts the identifications by itself where they are small.
    """
    usable = idens if keep_decoys else idens.where(~F.col("is_decoy"))
    modified = [F.col(c) if c in usable.columns else F.lit(None).cast(kind).alias(c) for c, kind in MODIFICATIONS.items()]
    right = usable.select(F.col("ms_file").alias("file_stem"), "native_id", "peptide", *modified, F.col("charge").alias("iden_charge"), "probability")
    return index.join(right, ["file_stem", "native_id"], "left")


def unidentified(index: DataFrame, idens: DataFrame) -> DataFrame:
    return index.join(idens.where(~F.col("is_decoy")).select(F.col("ms_file").alias("file_stem"), "native_id"), ["file_stem", "native_id"], "left_anti")


def named_members(member: DataFrame, index: DataFrame, idens: DataFrame) -> DataFrame:
    """(cluster_id, node_id, mass, iden, probability); iden is the peptide with whole modification masses, and the charge."""
    text = with_integer_masses(*[F.col(c) for c in ("peptide", *MODIFICATIONS)])
    named = identified(index, idens).select("node_id", "mass", identity(text, F.col("iden_charge")).alias("iden"), "probability")
    return member.select("cluster_id", "node_id").join(named, "node_id")


def enrich(member: DataFrame, index: DataFrame, idens: DataFrame) -> DataFrame:
    """(cluster_id, num_nodes, num_idens, idens, major_iden, iden_ratio, mass_avg).

    num_idens counts different identifications; idens lists them by count, then name;
    iden_ratio is the share of identified nodes.  Without any, num_idens and iden_ratio are 0 and the rest null.
    """
    nodes = named_members(member, index, idens)
    totals = nodes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("num_nodes"), F.count("iden").alias("named"), F.avg(F.col("mass").cast("double")).alias("mass_avg"))
    counts = nodes.where("iden is not null").groupBy("cluster_id", "iden").agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "iden", "n"))).alias("h"))
    out = totals.join(lists, "cluster_id", "left")
    return out.select(
        "cluster_id", "num_nodes", F.coalesce(F.size("h"), F.lit(0)).alias("num_idens"), histogram_text(F.col("h")).alias("idens"), F.get(F.col("h"), F.lit(0))["iden"].alias("major_iden"),
        (F.col("named") / F.col("num_nodes")).alias("iden_ratio"), "mass_avg",
    )


IDENTIFICATIONS = (
    "ms_file string, native_id long, peptide string, charge int, probability double, source string, is_decoy boolean, prev_aa string, next_aa string, "
    "mods array<struct<pos:int,mass:double>>, nterm_mod double, cterm_mod double, iden_file_id int, position long"
)


def stored_identifications(idens: DataFrame | None, spark: SparkSession, threshold: float = 0.9, include_decoy: bool = False, counts: Observation | None = None) -> DataFrame:
    """The table that a run keeps: one row for each scan, all columns of IDENTIFICATIONS (null where the input lacks them); empty without input.

    ``counts`` is filled while the table is made: total, unsure, decoys (of the sure ones, where they are left out) and taken, from which scans with several rows follow.
    """
    kinds = [(f.name, f.dataType) for f in spark.createDataFrame([], IDENTIFICATIONS).schema.fields]
    idens = spark.createDataFrame([], IDENTIFICATIONS) if idens is None else idens
    whole = idens.select(*[(F.col(n) if n in idens.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds])
    if counts is not None:
        sure = F.coalesce(F.col("probability") >= threshold, F.lit(False))
        out = sure & ~F.coalesce(~F.col("is_decoy"), F.lit(False)) & F.lit(not include_decoy)
        whole = whole.observe(counts, F.count(F.lit(1)).alias("total"), F.count_if(~sure).alias("unsure"), F.count_if(out).alias("decoys"), F.count_if(sure & ~out).alias("taken"))
    return dedup_identifications(filter_identifications(whole, threshold, include_decoy))


def update_enrichment(clusters: DataFrame, member: DataFrame, index: DataFrame, idens: DataFrame, update: bool = False) -> DataFrame:
    """``clusters`` (columns of ``enrich``) with the pending ones, or all with ``update``, enriched anew; the others stay as they are."""
    pending = needs_enrichment(clusters, update).select("cluster_id")
    fresh = enrich(member.join(pending, "cluster_id", "left_semi"), index, idens)
    return clusters.join(pending, "cluster_id", "left_anti").select(fresh.columns).unionByName(fresh)


def needs_enrichment(clusters: DataFrame, update: bool = False) -> DataFrame:
    return clusters if update else clusters.where(F.coalesce("num_idens", F.lit(0)) == 0)


def _weighted_entropy(counts: DataFrame, group: str) -> DataFrame:
    """Entropy (bits) of ``n`` inside each group, weighted by the group's total."""
    share = F.col("n") / F.sum("n").over(W.partitionBy(group))
    per = counts.withColumn("h", -share * F.log2(share)).groupBy(group).agg(F.sum("h").alias("h"), F.sum("n").alias("n"))
    return per.agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("entropy"))


def entropies(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entropy of identifications inside clusters, entropy of clusters inside identifications), each one row; null without identifications."""
    counts = nodes.where("iden is not null").groupBy("cluster_id", "iden").agg(F.count(F.lit(1)).alias("n"))
    return _weighted_entropy(counts, "cluster_id"), _weighted_entropy(counts, "iden")
