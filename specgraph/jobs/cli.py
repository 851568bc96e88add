"""Command line: files to clusters, and clusters to text.

    spark-submit -m specgraph.jobs.cli ROOT FILE... [--config FILE] [--list FILE] [--ignore-errors] [--preparation-only] [--enrich pending|all] [--entropy] [--export PATH] [--export-one CLUSTER PATH]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgraph.config import Params, parse
from specgraph.jobs import export
from specgraph.jobs.engine import LOOKUPS, STAGES, Engine
from specgraph.jobs.ingest import gather, ingest
from specgraph.jobs.inputs import InputStore
from specgraph.operators import clusters, enrich


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="specgraph", description="Cluster spectra by rank dot products.")
    p.add_argument("root", help="folder of the run; a finished stage found there is reused if the files' contents and the parameters are the same")
    p.add_argument("files", nargs="*", help="mzXML, mzML and pepXML files, or folders that hold them")
    p.add_argument("--list", help="file with one path on each line")
    p.add_argument("--config", help="file of key = value lines")
    p.add_argument("--ignore-errors", action="store_true", help="skip scans and files that can't be read")
    p.add_argument("--preparation-only", action="store_true", help="stop before similarities")
    p.add_argument("--enrich", choices=["pending", "all"], help="enrich the clusters without identification, or all, anew in the tables of the run")
    p.add_argument("--entropy", action="store_true", help="print the entropies of identifications in clusters and of clusters in identifications")
    p.add_argument("--export", help="folder for the text of all clusters")
    p.add_argument("--export-one", nargs=2, metavar=("CLUSTER", "FOLDER"), help="add the text of one cluster to a folder")
    return p.parse_args(argv)


def exported(run: Engine) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, nodes, edges) of a run as the export takes them."""
    member, index = run.stage("refined"), run.stage("index")
    nodes = enrich.named_members(member, index, run.stage("idens")).drop("mass").join(index, "node_id")
    edges = clusters.edge_counts(clusters.inner_edges(run.folded_edges()[0], member))
    return run.stage("enriched").join(edges, "cluster_id", "left"), nodes, run.inside()


def export_all(run: Engine, path: str) -> None:
    export.write_lines(export.cluster_lines(*exported(run)), path)


def export_one(run: Engine, path: str, cluster_id: int) -> None:
    """One cluster's text, added to a folder that may hold others; an unknown cluster is an error."""
    if not clusters.exists(run.stage("refined"), cluster_id):
        raise ValueError(f"cluster {cluster_id} doesn't exist")
    export.append_lines(export.cluster_lines(*(t.where(F.col("cluster_id") == cluster_id) for t in exported(run))), path)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> Engine:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("specgraph").getOrCreate()
    text = lambda path: "\n".join(r.value for r in spark.read.text(path).collect()) if path else ""
    params = parse(text(args.config)) if args.config else Params()
    files = gather(spark, args.files, text(args.list), args.ignore_errors)

    store = InputStore(spark, args.root).update(files, "DROPMALFORMED" if args.ignore_errors else "FAILFAST")

    def source():
        found = ingest(store)
        return found.index, found.peaks, found.idens

    run = Engine(spark, args.root, params=params, renumber=True, source=source, label=store.label())
    run.load()
    run.store = store
    for stage in ("index", "ranked") if args.preparation_only else [s for s in STAGES if s not in LOOKUPS]:
        run.stage(stage)
    run.save()
    if args.enrich and not args.preparation_only:
        run.update_enrichment(update=args.enrich == "all")
    if args.entropy and not args.preparation_only:
        for what, table in zip(("identifications in clusters", "clusters in identifications"), enrich.entropies(enrich.named_members(run.stage("refined"), run.stage("index"), run.stage("idens")))):
            print(f"entropy of {what}: {table.head().entropy}")
    if args.export and not args.preparation_only:
        export_all(run, args.export)
    if args.export_one and not args.preparation_only:
        export_one(run, args.export_one[1], int(args.export_one[0]))
    return run


if __name__ == "__main__":
    main()
