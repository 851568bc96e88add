"""Files to exported clusters through the command line."""

import os
import random

import pytest
from pyspark.sql import functions as F

from specgraph import storage
from specgraph.config import Params
from specgraph.jobs import cli, ingest
from specgraph.jobs.engine import Engine
from specgraph.jobs.inputs import InputStore, checksums
from tests.test_sources import mzml_array, mzxml_scan, query


def scan_peaks(seed, n=14):
    rng = random.Random(seed)
    return sorted((m + 0.5, float(rng.randint(1, 50))) for m in rng.sample(range(100, 300), n))


@pytest.fixture
def folder(tmp_path):
    near = scan_peaks(1)
    body = mzxml_scan(1, 2, 500.5, 2, near) + mzxml_scan(2, 2, 500.9, 2, near[:-1] + [(299.0, 1.0)]) + mzxml_scan(3, 2, 700.0, 2, scan_peaks(2)) + mzxml_scan(4, 2, 500.5, 2, near[:3])
    (tmp_path / "a.mzXML").write_text(f"<msRun>{body}</msRun>")
    m, i = zip(*near)
    (tmp_path / "b.mzML").write_text(
        f'<mzML><spectrum index="0" id="scan=9" defaultArrayLength="{len(near)}"><cvParam name="ms level" value="2"/><precursorList count="1"><cvParam name="selected ion m/z" value="501.0"/></precursorList>'
        f'<binaryDataArrayList count="2">{mzml_array("m/z", m, 64, True)}{mzml_array("intensity", i, 32, False)}</binaryDataArrayList></spectrum></mzML>'
    )
    (tmp_path / "c.pep.xml").write_text("<x>" + query("a", 1, "PEPK", ip="0.99") + query("b", 9, "PEPK", ip="0.95") + query("a", 2, "AAA", pp="0.5") + "</x>")
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def test_gather(spark, folder):
    found = ingest.gather(spark, [str(folder)])
    assert {k: [p.rsplit("/", 1)[-1] for p in v] for k, v in found.items()} == {"mzxml": ["a.mzXML"], "mzml": ["b.mzML"], "pepxml": ["c.pep.xml"]}
    assert ingest.gather(spark, [], f"\n{folder}/a.mzXML\n")["mzxml"]
    with pytest.raises(ValueError):
        ingest.gather(spark, [f"{folder}/notes.txt"])
    assert not any(ingest.gather(spark, [f"{folder}/notes.txt"], ignore_unknown=True).values())


def test_command_line(spark, folder, tmp_path):
    (folder / "run.conf").write_text("removal_range = (0, 0)\n")
    run = cli.main([str(tmp_path / "run"), str(folder), "--config", f"{folder}/run.conf", "--export", str(tmp_path / "out")], spark)
    assert run.stage("index").count() == 4  # scan 4 has too few peaks
    rows = run.stage("enriched").collect()
    assert [(r.num_nodes, r.num_idens, r.major_iden) for r in rows] == [(3, 1, "PEPK/2")]
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines.count("# Cluster") == 2 and sum("PEPK/2" in x for x in lines) == 3 and "# Edges" in lines
    index = {(r.file_stem, r.native_id): r.node_id for r in run.stage("index").collect()}
    assert index == {("a", 1): 0, ("a", 2): 1, ("b", 9): 2, ("a", 3): 3}
    # Again: nothing is read or computed anew; one cluster can be exported by itself.
    cluster = str(rows[0].cluster_id)
    again = cli.main([str(tmp_path / "run"), str(folder), "--config", f"{folder}/run.conf", "--export-one", cluster, str(tmp_path / "one")], spark)
    assert again.manifest["stages"] == run.manifest["stages"] and again._inputs is None
    assert [r.value for r in spark.read.text(str(tmp_path / "one")).collect()].count("# Cluster") == 2  # one in the header
    with pytest.raises(ValueError, match="doesn't exist"):
        cli.export_one(again, str(tmp_path / "one"), 12345)
    (folder / "run.conf").write_text("removal_range = (0, 0)\nmin_scan_peaks = 1\n")
    more = cli.main([str(tmp_path / "run"), str(folder), "--config", f"{folder}/run.conf"], spark)
    assert more.stage("index").count() == 5 and more.manifest["stages"]["idens"] == run.manifest["stages"]["idens"]


def test_preparation_only_and_bad_files(spark, folder, tmp_path):
    (folder / "bad.mzXML").write_text(f"<msRun>{mzxml_scan(1, 2)}</msRun>")
    with pytest.raises(Exception, match="precursorMz is missing"):
        cli.main([str(tmp_path / "r1"), str(folder)], spark)
    run = cli.main([str(tmp_path / "r2"), str(folder), "--ignore-errors", "--preparation-only"], spark)
    assert set(run.manifest["stages"]) == {"index", "ranked"}


# --- inputs by content


def scan_file(path, seeds, charge=2):
    path.write_text("<msRun>\n" + "\n".join(mzxml_scan(i + 1, 2, 500.0 + s, charge, scan_peaks(s)) for i, s in enumerate(seeds)) + "\n</msRun>")


def tables_left(spark):
    return set(storage.names(spark, f"{storage.shared_dir(spark)}/tables"))


def test_checksums_follow_the_bytes_and_not_the_cuts(spark, tmp_path):
    rng = random.Random(3)
    contents = {"a b+%.xml": "<x>" * 2000 + "y" * 5000, "b.xml": "".join(rng.choice("<>ab") for _ in range(20_000)), "c.xml": "no end", "empty.xml": ""}
    for name, text in contents.items():
        (tmp_path / name).write_text(text)
    paths = [f"{tmp_path}/{n}" for n in contents]

    def found():
        return {r.path.rsplit("/", 1)[-1]: r.checksum for r in checksums(spark, paths).collect()}

    before = found()
    assert set(before) == set(contents) - {"empty.xml"}
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(key, "700")
        assert found() == before
    finally:
        spark.conf.set(key, old)
    text = contents["b.xml"]
    at = text.index("ab")
    (tmp_path / "b.xml").write_text(text[:at] + "ba" + text[at + 2 :])
    pieces = contents["a b+%.xml"].replace("<x>", "<z>", 1)
    (tmp_path / "a b+%.xml").write_text("<x>" + pieces[3:])  # as it was
    after = found()
    assert after["b.xml"] != before["b.xml"] and {k: v for k, v in after.items() if k != "b.xml"} == {k: v for k, v in before.items() if k != "b.xml"}
    (tmp_path / "b.xml").write_text(text.replace(">a", ">b>a>", 1))
    assert found()["b.xml"] != before["b.xml"] and checksums(spark, []).count() == 0


def test_a_rewritten_file_is_read_again_and_no_other(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(5):
        scan_file(source / f"f{k}.mzXML", [k, k + 10])
    (source / "i.pep.xml").write_text("<x>" + query("f0", 1, "PEPK", ip="0.99") + "</x>")
    there = tables_left(spark)
    run = cli.main([str(tmp_path / "run"), str(source)], spark)
    assert len(run.store.fresh) == 6 and run.stage("index").count() == 10 and run._inputs is None
    assert {i.rows for i in run.store.inputs} == {1, 2} and run.store.table().count() == 6
    stat = os.stat(source / "f3.mzXML")
    same = (source / "f3.mzXML").read_text().replace('precursorCharge="2"', 'precursorCharge="3"')
    (source / "f3.mzXML").write_text(same)
    os.utime(source / "f3.mzXML", ns=(stat.st_atime_ns, stat.st_mtime_ns))  # same name, length and time
    again = cli.main([str(tmp_path / "run"), str(source)], spark)
    assert [p.rsplit("/", 1)[-1] for p in again.store.fresh] == ["f3.mzXML"]
    charges = {(r.file_stem, r.charge) for r in again.stage("index").select("file_stem", "charge").distinct().collect()}
    assert charges == {("f0", 2), ("f1", 2), ("f2", 2), ("f3", 3), ("f4", 2)}
    # Identifications are other files: their stage stays, what follows from scans doesn't.
    assert again.manifest["stages"]["idens"] == run.manifest["stages"]["idens"] and again.manifest["stages"]["index"]["id"] != run.manifest["stages"]["index"]["id"]
    (source / "i.pep.xml").write_text("<x>" + query("f0", 1, "AAAK", ip="0.99") + "</x>")
    third = cli.main([str(tmp_path / "run"), str(source)], spark)
    assert len(third.store.fresh) == 1 and third.manifest["stages"]["edges"] == again.manifest["stages"]["edges"]
    assert third.manifest["stages"]["idens"]["id"] != again.manifest["stages"]["idens"]["id"] and third.stage("idens").head().peptide == "AAAK"
    # A file more, one less: only the new one is read.
    scan_file(source / "g.mzXML", [20])
    (source / "f0.mzXML").unlink()
    fourth = cli.main([str(tmp_path / "run"), str(source)], spark)
    assert [p.rsplit("/", 1)[-1] for p in fourth.store.fresh] == ["g.mzXML"] and fourth.stage("index").count() == 9
    fresh = cli.main([str(tmp_path / "new"), str(source)], spark)
    table = lambda r, s: sorted(map(str, r.stage(s).drop("file_path").collect()))
    assert all(table(fourth, s) == table(fresh, s) for s in ("index", "edges", "members", "idens", "enriched"))
    assert tables_left(spark) == there  # nothing written on the way stays


def test_torn_inputs_are_read_again(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        scan_file(source / f"f{k}.mzXML", [k])
    files = ingest.gather(spark, [str(source)])
    store = InputStore(spark, str(tmp_path / "run")).update(files)
    assert len(store.fresh) == 3 and InputStore(spark, str(tmp_path / "run")).update(files).fresh == []
    torn = store.inputs[1]
    (part,) = [n for n in storage.names(spark, f"{torn.folder}/input={torn.input}") if n.endswith(".parquet")]
    storage.delete(spark, f"{torn.folder}/input={torn.input}/{part}")
    again = InputStore(spark, str(tmp_path / "run")).update(files)
    assert again.fresh == [torn.path] and len(again.refused) == 1 and again.scans().count() == 3
    assert InputStore(spark, str(tmp_path / "run")).update({}).scans().count() == 0
    # Bad scans are counted by file, and another way of reading is another input.
    (source / "bad.mzXML").write_text(f"<msRun>{mzxml_scan(1, 2)}</msRun>")
    files = ingest.gather(spark, [str(source)])
    with pytest.raises(Exception, match="precursorMz is missing"):
        InputStore(spark, str(tmp_path / "run")).update(files)
    lenient = InputStore(spark, str(tmp_path / "run")).update(files, "DROPMALFORMED")
    assert {i.path.rsplit("/", 1)[-1]: (i.rows, i.malformed) for i in lenient.inputs} == {"bad.mzXML": (1, 1), "f0.mzXML": (1, 0), "f1.mzXML": (1, 0), "f2.mzXML": (1, 0)}


def small_run(spark, root, params=None, label=None):
    index = spark.createDataFrame([(i, float(100 + i % 2), 1, "f", i) for i in range(6)], "node_id long, mass float, charge int, file_stem string, native_id long")
    peaks = spark.createDataFrame([(i, float(b), 1.0 + b) for i in range(6) for b in range(12)], "node_id long, mz float, intensity double")
    return Engine(spark, str(root), index, peaks, None, params or Params(removal_range=(0.0, 0.0), dp_threshold=0.5), label=label)


def test_torn_and_foreign_stages_are_refused(spark, tmp_path):
    run = small_run(spark, tmp_path / "a", label=["x"])
    rows = run.stage("enriched").collect()
    record = run.manifest["stages"]["edges"]
    assert record["rows"] == 15 and record["files"] >= 1 and run.stage("edges").count() == 15
    assert small_run(spark, tmp_path / "a", label=["x"]).load().manifest["stages"] == run.manifest["stages"]
    # The table of another run's stage, at its place or mounted.
    other = small_run(spark, tmp_path / "b", label=["x"])
    other.stage("edges")
    with pytest.raises(ValueError, match="not a stage"):
        other.mount("edges", str(tmp_path))
    with pytest.raises(ValueError, match="another table"):
        other.mount("members", record["path"])
    with pytest.raises(ValueError, match="other tables"):
        other.mount("edges", record["path"])
    fresh = small_run(spark, tmp_path / "c", label=["x"])
    assert fresh.mount("edges", record["path"]).count() == 15
    with pytest.raises(ValueError, match="other inputs"):
        small_run(spark, tmp_path / "d", label=["y"]).mount("edges", record["path"])
    with pytest.raises(ValueError, match="other parameters"):
        small_run(spark, tmp_path / "d", Params(dp_threshold=0.9), label=["x"]).mount("edges", record["path"])
    # A part file gone: the stage and what was made from it are made again, what came before stays.
    (part, *_) = [n for n in storage.names(spark, record["path"]) if n.endswith(".parquet")]
    storage.delete(spark, f"{record['path']}/{part}")
    with pytest.raises(ValueError, match="missing"):
        small_run(spark, tmp_path / "e", label=["x"]).mount("edges", record["path"])
    again = small_run(spark, tmp_path / "a", label=["x"]).load()
    assert set(again.manifest["stages"]) == {"index", "ranked", "idens"} and "missing" in again.refused["edges"]
    assert again.stage("enriched").collect() == rows
    storage.delete(spark, f"{again.manifest['stages']['ranked']['path']}/_SUCCESS")
    assert small_run(spark, tmp_path / "a", label=["x"]).load().refused == {"ranked": "not complete"}


def test_a_crash_while_saving_leaves_the_manifest_before(spark, tmp_path):
    run = small_run(spark, tmp_path / "a")
    run.stage("index")
    names = run._manifests()
    (tmp_path / "a" / "manifests" / "00000009.json.ab.part").write_text('{"half')
    assert run.saved()["stages"].keys() == {"index"} and run._manifests() == names
    run.stage("ranked")
    assert run.saved()["stages"].keys() == {"index", "ranked"} and len(run._manifests()) == 2


# --- one cluster


def test_one_cluster_is_read_from_one_bucket(spark, tmp_path):
    rows = [(i, float(100 + 5 * (i // 6)), 1, "f", i) for i in range(240)]
    index = spark.createDataFrame(rows, "node_id long, mass float, charge int, file_stem string, native_id long")
    peaks = spark.createDataFrame([(i, float(b), 1.0 + b) for i in range(240) for b in range(12)], "node_id long, mz float, intensity double")
    run = Engine(spark, str(tmp_path / "a"), index, peaks, None, Params(removal_range=(0.0, 0.0), dp_threshold=0.5))
    whole = run.stage("edges").collect()
    assert run.stage("refined").select("cluster_id").distinct().count() == 40
    for c in (0, 6, 234):
        nodes, edges = run.cluster(c)
        assert sorted(r.node_id for r in nodes.collect()) == list(range(c, c + 6)) and {"mass", "file_stem"} <= set(nodes.columns)
        assert sorted((r.src, r.dst, round(r.dp, 9)) for r in edges.collect()) == sorted((r.src, r.dst, round(r.dp, 9)) for r in whole if c <= r.src < c + 6)
        for table in (nodes, edges):
            plan = table._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(cluster_id), EqualTo(cluster_id" in plan
        assert nodes.select(F.input_file_name()).distinct().count() == 1
    assert sorted(r.other for r in run.neighbours(6, 8).collect()) == [6, 7, 9, 10, 11]
    assert run.cluster(999)[0].count() == 0 == run.cluster(999)[1].count()
    folders = [n for n in storage.names(spark, run.manifest["stages"]["nodes_by_cluster"]["path"]) if n.startswith("bucket=")]
    assert len(folders) > 10
    # A new run over the same folder takes the tables over.
    assert set(Engine(spark, str(tmp_path / "a"), params=run.params).load().manifest["stages"]) == set(run.manifest["stages"])


def test_counts_on_the_way(spark, tmp_path):
    """What the identification store left out, and why, in the manifest without a second pass."""
    rows = [("f", 1, "A", 2, 0.95, False, 0, 1), ("f", 1, "B", 2, 0.99, False, 0, 2), ("f", 2, "D", 3, 0.5, False, 0, 3), ("f", 3, "E", 3, 0.97, True, 0, 4), ("f", 4, "E", 3, 0.97, False, 0, 5), ("f", 5, "E", 3, None, False, 0, 6)]
    idens = spark.createDataFrame(rows, "ms_file string, native_id long, peptide string, charge int, probability double, is_decoy boolean, iden_file_id int, position long")
    run = small_run(spark, tmp_path / "a")
    run = Engine(spark, str(tmp_path / "b"), run.inputs["index"], run.inputs["peaks"], idens, run.params)
    assert run.stage("idens").count() == 2
    assert run.manifest["stages"]["idens"]["counts"] == {"total": 6, "unsure": 2, "decoys": 1, "taken": 3, "duplicates": 1}
    none = small_run(spark, tmp_path / "c")
    none.stage("idens")
    assert none.manifest["stages"]["idens"]["counts"] == {"total": 0, "unsure": 0, "decoys": 0, "taken": 0, "duplicates": 0}


def test_enrichment_in_place(spark, tmp_path):
    """Buckets without pending clusters keep their files; the manifest switches from the old table to the new."""
    index = spark.createDataFrame([(i, float(100 + 5 * (i // 4)), 1, "f", i) for i in range(120)], "node_id long, mass float, charge int, file_stem string, native_id long")
    peaks = spark.createDataFrame([(i, float(b), 1.0 + b) for i in range(120) for b in range(12)], "node_id long, mz float, intensity double")
    schema = "ms_file string, native_id long, peptide string, charge int, probability double, is_decoy boolean, iden_file_id int, position long"
    idens = lambda ids: spark.createDataFrame([("f", i, f"P{i // 4}", 2, 0.95, False, 0, i) for i in ids], schema)
    most = [i for i in range(120) if i // 4 not in (3, 17)]
    params = Params(removal_range=(0.0, 0.0), dp_threshold=0.5)
    run = Engine(spark, str(tmp_path / "a"), index, peaks, idens(most), params)
    before = {r.cluster_id: r.major_iden for r in run.stage("enriched").collect()}
    assert sum(v is None for v in before.values()) == 2 and "bucket" not in run.stage("enriched").columns
    files = lambda: {r.c: r.f for r in run._table("enriched").select(F.col("cluster_id").alias("c"), F.input_file_name().alias("f")).collect()}
    old, manifest = files(), dict(run.manifest["stages"]["enriched"])
    after = {r.cluster_id: r.major_iden for r in run.update_enrichment(idens(range(120))).collect()}
    assert after == {c: f"P{c // 4}/2" for c in before} and run.manifest["stages"]["enriched"]["id"] != manifest["id"]
    new = files()
    buckets = {r.c: r.b for r in run._table("enriched").select(F.col("cluster_id").alias("c"), F.col("bucket").alias("b")).collect()}
    touched = {buckets[12], buckets[68]}
    assert all((new[c] == old[c]) == (buckets[c] not in touched) for c in before) and any(buckets[c] not in touched for c in before)
    # The run as saved is the new one, whole; a torn piece is refused.
    again = Engine(spark, str(tmp_path / "a"), params=params, label=run.manifest["label"]).load()
    assert again.manifest["stages"] == run.manifest["stages"] and {r.cluster_id: r.major_iden for r in again.stage("enriched").collect()} == after
    whole = {r.cluster_id: r.major_iden for r in run.update_enrichment(idens([]), update=True).collect()}
    assert set(whole) == set(before) and not any(whole.values()) and len(run.manifest["stages"]["enriched"]["replaced"]) == 1
    storage.delete(spark, f"{run.manifest['stages']['enriched']['replaced'][0]['path']}/_SUCCESS")
    torn = Engine(spark, str(tmp_path / "a"), params=params, label=run.manifest["label"]).load()
    assert "enriched" not in torn.manifest["stages"] and "missing" in torn.refused["enriched"] and torn.stage("refined").count() == 120
