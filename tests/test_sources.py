"""mzXML, mzML and pepXML readers on files written here."""

import base64
import random
import struct
import zlib

import pytest

from specgraph.sources import indexed, mzml, mzxml, pepxml, ranges, writers, xmlscan

PEAKS = [(100.5, 1.0), (200.25, 3.0), (300.125, 2.0)]


def mzxml_peaks(peaks, bits, packed):
    raw = b"".join(struct.pack(">ff" if bits == 32 else ">dd", m, i) for m, i in peaks)
    text = base64.b64encode(zlib.compress(raw) if packed == "zlib" else raw).decode()
    kind = f' compressionType="{packed}"' if packed else ""
    return f'<peaks precision="{bits}"{kind} byteOrder="network">{text}</peaks>'


def mzxml_scan(num, level, mz=None, charge=None, peaks=PEAKS, bits=32, packed="none", inner="", body=None):
    c = f' precursorCharge="{charge}"' if charge else ""
    pre = f"<precursorMz{c}>{mz}</precursorMz>" if mz else ""
    return f'<scan num="{num}" msLevel="{level}" peaksCount="{len(peaks)}">{pre}{body or mzxml_peaks(peaks, bits, packed)}{inner}</scan>'


def mzml_array(kind, values, bits, packed):
    raw = struct.pack(f"<{len(values)}{'f' if bits == 32 else 'd'}", *values)
    text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
    return f'<binaryDataArray><cvParam name="{bits}-bit float"/><cvParam name="{"zlib" if packed else "no"} compression"/><cvParam name="{kind} array"/><binary>{text}</binary></binaryDataArray>'


def mzml_spectrum(scan, level, mz="500.5", charge=2, bits=32, packed=False, precursors=1):
    c = f'<cvParam name="charge state" value="{charge}"/>' if charge else ""
    m, i = zip(*PEAKS)
    return (
        f'<spectrum index="0" id="controller=0 scan={scan}" defaultArrayLength="{len(PEAKS)}"><cvParam name="ms level" value="{level}"/>'
        f'<precursorList count="{precursors}"><cvParam name="selected ion m/z" value="{mz}"/>{c}</precursorList>'
        f'<binaryDataArrayList count="2">{mzml_array("m/z", m, bits, packed)}{mzml_array("intensity", i, bits, not packed)}</binaryDataArrayList></spectrum>'
    )


def test_mzxml(spark, tmp_path):
    nested = mzxml_scan(2, 2, 400.5, 3) + mzxml_scan(3, 2, 401.5, bits=64, packed="zlib")
    path = tmp_path / "a.mzXML"
    path.write_text(f"<mzXML><msRun>{mzxml_scan(1, 1, inner=nested)}{mzxml_scan(4, 2, 402.5, 1, peaks=PEAKS[:1])}</msRun><index></index></mzXML>")
    rows = {r.native_id: r for r in xmlscan.good(mzxml.read(spark, [str(path)], min_peaks=2)).collect()}
    assert set(rows) == {2, 3}
    assert (rows[2].charge, rows[3].charge, rows[3].precursor_mz, rows[2].file_stem) == (3, 1, 401.5, "a")
    for r in rows.values():
        assert [(p.mz, p.intensity) for p in r.peaks] == PEAKS
        assert 'msLevel="2"' in xmlscan.raw_block(spark, str(path), r.start, r.end)


def test_malformed_scans(spark, tmp_path):
    path = tmp_path / "b.mzXML"
    path.write_text(f"<msRun>{mzxml_scan(1, 2, 400.5)}{mzxml_scan(2, 2)}{mzxml_scan(3, 2, 4.5, packed='rot13')}</msRun>")
    rows = mzxml.read(spark, [str(path)], mode="DROPMALFORMED")
    assert [r.native_id for r in xmlscan.good(rows).collect()] == [1]
    assert xmlscan.malformed(rows).count() == 2
    with pytest.raises(Exception, match="precursorMz is missing"):
        mzxml.read(spark, [str(path)]).collect()
    with pytest.raises(ValueError):
        mzxml.read(spark, [str(path)], mode="PERHAPS")
    assert mzxml.read(spark, []).count() == 0


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """Byte ranges of a file go to different tasks; every scan is found once, with its place in the file."""
    xml, ml = tmp_path / "big.mzXML", tmp_path / "big.mzML"
    xml.write_text("<mzXML><msRun>é" + "".join(mzxml_scan(k, 1 + (k % 7 > 0), 400.5 + k, 2) + "\n  " for k in range(1, 400)) + "</msRun><index><offset id='1'>9</offset></index></mzXML>")
    ml.write_text("<mzML><spectrumList>" + "".join(mzml_spectrum(k, 2) + "\n" for k in range(1, 200)) + "</spectrumList></mzML>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for path, reader, want in ((xml, mzxml, [k for k in range(1, 400) if k % 7]), (ml, mzml, list(range(1, 200)))):
            pieces = spark.read.option("lineSep", "</peaks>").text(str(path))
            assert pieces.rdd.getNumPartitions() >= 6
            rows = reader.read(spark, [str(path)]).collect()
            assert sorted(r.native_id for r in rows) == want
            raw = path.read_bytes()
            for r in rows:
                block = raw[r.start : r.end].decode()
                assert block.startswith("<s") and (f'num="{r.native_id}"' in block or f'scan={r.native_id}"' in block) and block.count("<s" + block[2:5]) == 1
            assert xmlscan.raw_block(spark, str(path), rows[5].start, rows[5].end) == raw[rows[5].start : rows[5].end].decode()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_unsorted_peaks(spark, tmp_path):
    path = tmp_path / "u.mzXML"
    path.write_text(f"<msRun>{mzxml_scan(1, 2, 400.5, peaks=[PEAKS[1], PEAKS[0], PEAKS[2]])}{mzxml_scan(2, 2, 400.5)}</msRun>")
    with pytest.raises(Exception, match="aren't in order"):
        mzxml.read(spark, [str(path)]).collect()
    rows = {r.native_id: [(p.mz, p.intensity) for p in r.peaks] for r in mzxml.read(spark, [str(path)], "DROPMALFORMED").collect()}
    assert rows == {1: PEAKS, 2: PEAKS}


def test_mzml(spark, tmp_path):
    path = tmp_path / "c.mzML"
    path.write_text("<mzML>" + mzml_spectrum(1, 1) + mzml_spectrum(2, 2, bits=64, packed=True) + mzml_spectrum(3, 2, charge=None) + mzml_spectrum(4, 2, precursors=2) + "</mzML>")
    rows = mzml.read(spark, [str(path)], mode="DROPMALFORMED")
    found = {r.native_id: r for r in xmlscan.good(rows).collect()}
    assert set(found) == {2, 3} and xmlscan.malformed(rows).count() == 1
    assert (found[2].charge, found[3].charge, found[2].precursor_mz) == (2, 1, 500.5)
    assert all([(p.mz, p.intensity) for p in r.peaks] == PEAKS for r in found.values())


def query(name, scan, peptide, protein="sp|X", ip=None, pp=None, mods="", n="", c=""):
    results = (f'<analysis_result analysis="peptideprophet"><peptideprophet_result probability="{pp}"/></analysis_result>' if pp else "") + (f'<analysis_result analysis="interprophet"><interprophet_result probability="{ip}"/></analysis_result>' if ip else "")
    info = f"<modification_info{n}{c}>{mods}</modification_info>" if mods or n or c else ""
    return f'<spectrum_query spectrum="{name}.{scan}.{scan}.2" start_scan="{scan}" assumed_charge="2"><search_result><search_hit hit_rank="1" peptide="{peptide}" protein="{protein}" peptide_prev_aa="K" peptide_next_aa="R">{info}{results}</search_hit></search_result></spectrum_query>'


def test_pepxml(spark, tmp_path):
    one = '<mod_aminoacid_mass position="3" mass="160.03"/>'
    path = tmp_path / "d.pep.xml"
    path.write_text("<msms_pipeline_analysis><msms_run_summary>" + query("f", 1, "PEPK", pp="0.8", ip="0.95", mods=one) + query("f", 2, "AAK", "DECOY_1", pp="0.7", mods=one * 2, n=' mod_nterm_mass="43.0"') + query("f", 3, "CCK") + "</msms_run_summary></msms_pipeline_analysis>")
    rows = {r.native_id: r for r in pepxml.read(spark, [str(path)]).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].probability, rows[1].source, rows[1].is_decoy, rows[1].ms_file) == (0.95, "ip", False, "f")
    assert (rows[2].probability, rows[2].source, rows[2].is_decoy, rows[2].nterm_mod) == (0.7, "pp", True, 43.0)
    assert [len(rows[i].mods) for i in (1, 2)] == [1, 2] and rows[1].mods[0].mass == 160.03
    raw = path.read_text()
    assert all(f'start_scan="{k}"' in raw[r.l_offset : r.r_offset] for k, r in rows.items())


def test_pepxml_files_and_order(spark, tmp_path):
    """All files in one load; the last row of a scan has the highest position, however the file is cut."""
    paths = []
    for i in range(3):
        paths.append(str(tmp_path / f"x +{i}.pep.xml"))
        body = "".join(query("f", k % 50, "PEP" + "ACDEFGHIKL"[k // 50], pp="0.9") for k in range(200))
        (tmp_path / f"x +{i}.pep.xml").write_text(f"<a><b>{body}</b></a>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6k")
    try:
        rows = pepxml.read(spark, paths).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 600
    for i in range(3):
        own = sorted((r for r in rows if r.iden_file_id == i), key=lambda r: r.position)
        assert [(r.native_id, r.peptide) for r in own] == [(k % 50, "PEP" + "ACDEFGHIKL"[k // 50]) for k in range(200)]


def test_paths():
    assert [xmlscan.kind_of(n) for n in ("x/a.mzXML", "a.MZML", "a.pep.xml", "a.ipro.pep.xml", "a.b.mzML", "a")] == ["mzxml", "mzml", "pepxml", "pepxml", None, None]
    assert xmlscan.list_paths("a\n\n  b \n#c\n") == ["a", "b", "#c"]
    assert xmlscan.stem_of("/x/y.z.mzML") == "y"


# --- files read by their own index


def indexed_file(path, scans, shift=0, count=None, index=True):
    """An mzXML file with an index; ``shift`` puts its offsets wrong."""
    text, offsets = f'<mzXML><msRun scanCount="{count or len(scans)}">\n', []
    for num, scan in scans:
        offsets.append((num, len(text)))
        text += scan + "\n"
    text += "</msRun>\n"
    if index:
        at = len(text)
        text += '<index name="scan">\n' + "".join(f'<offset id="{n}">{o + shift}</offset>\n' for n, o in offsets) + f"</index>\n<indexOffset>{at}</indexOffset>\n"
    path.write_text(text + "</mzXML>")


def some_scans(n, seed=1, size=6):
    rng = random.Random(seed)
    out = []
    for k in range(1, n + 1):
        peaks = [(100.0 + j, float(rng.randint(1, 99))) for j in range(size)]
        out.append((k, mzxml_scan(k, 1 + (k % 5 > 0), 400.5 + k, 2, peaks)))
    return out


def plain_rows(df):
    return sorted((r.native_id, r.start, r.end, r.precursor_mz, tuple(map(tuple, r.peaks or [])), r.error) for r in df.collect())


@pytest.mark.parametrize("fault", [{}, {"shift": 3}, {"count": 999}, {"index": False}])
def test_the_index_and_the_tags_give_the_same_scans(spark, tmp_path, monkeypatch, fault):
    path = tmp_path / "a.mzXML"
    indexed_file(path, some_scans(120), **fault)
    want = plain_rows(mzxml.read(spark, [str(path)]))
    assert [r[0] for r in want] == [k for k in range(1, 121) if k % 5]
    for part in (1 << 20, 3000, 777):
        assert plain_rows(indexed.read(spark, [str(path)], "mzxml", part_bytes=part)) == want
    monkeypatch.setattr(indexed, "STEP", 333)
    reader = indexed.ScanFilesReader({"path": str(path), "partbytes": "1500"})
    got = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted((r["native_id"], r["start"]) for r in got) == [r[:2] for r in want]


def test_few_scans_take_few_bytes(spark, tmp_path):
    path = tmp_path / "large.mzXML"
    indexed_file(path, some_scans(300, size=400))
    length = path.stat().st_size
    reader = indexed.ScanFilesReader({"path": str(path), "nativeids": "[7, 8, 201]"})
    (part,) = reader.partitions()
    rows = [r for b in reader.read(part) for r in b.to_pylist()]
    assert [r["native_id"] for r in rows] == [7, 8, 201] and reader.last.reads <= 5 and reader.last.bytes_read < length / 20
    # Level 1 scans are large here: their heads are enough.
    heads = tmp_path / "heads.mzXML"
    indexed_file(heads, [(k, mzxml_scan(k, 2 if k == 9 else 1, 400.5, 2, [(100.0 + j, 1.0) for j in range(5000)])) for k in range(1, 20)])
    reader = indexed.ScanFilesReader({"path": str(heads), "mslevel": "2"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["native_id"] for r in rows] == [9] and reader.last.bytes_read < heads.stat().st_size / 4


def test_scans_that_are_asked_for(spark, tmp_path):
    for k in range(3):
        indexed_file(tmp_path / f"f{k}.mzXML", some_scans(50, seed=k))
    paths = [f"{tmp_path}/f{k}.mzXML" for k in range(3)]
    rows = indexed.read(spark, paths, "mzxml", part_bytes=500)
    few = indexed.read(spark, paths, "mzxml", part_bytes=500, native_ids=[49, 3, 5, 1000], ms_level=2)
    assert sorted((r.file_stem, r.native_id) for r in few.collect()) == [(f"f{k}", n) for k in range(3) for n in (3, 49)]
    assert few.rdd.getNumPartitions() == 3 < rows.rdd.getNumPartitions()  # a task a file is enough for scans by number
    assert rows.count() == 120 and rows.union(few).count() == 126 and few.join(rows, "native_id").count() == 18 and rows.where("native_id = 4").count() == 3
    assert indexed.read(spark, paths, "mzxml", native_ids=[]).count() == 0 and indexed.read(spark, [], "mzxml").count() == 0
    with pytest.raises(Exception, match="unknown mode"):
        indexed.read(spark, paths, "mzxml", mode="PERHAPS").collect()


def test_written_files_have_an_index_that_leads_to_their_scans(spark, tmp_path):
    rows = [(k, 400.5 + k, 1 + k % 3, [(100.0 + j, float(j + k)) for j in range(4)]) for k in range(40)]
    scans = spark.createDataFrame(rows, "native_id long, precursor_mz double, charge int, peaks array<struct<mz:double,intensity:double>>").repartition(2)
    for kind, module in (("mzxml", mzxml), ("mzml", mzml)):
        folder = tmp_path / kind
        writers.indexed_lines(scans, kind).write.text(str(folder))
        paths = sorted(str(p) for p in folder.glob("part-*"))
        for path in paths:
            file = ranges.RangeFile(path)
            assert len(indexed.index_of(file, indexed.KINDS[kind])[0]) > 0
            file.close()
        got = indexed.read(spark, paths, kind, part_bytes=900)
        assert plain_rows(got) == plain_rows(module.read(spark, paths)) and got.count() == 40


def test_malformed_scans_by_the_index(spark, tmp_path):
    path = tmp_path / "b.mzXML"
    indexed_file(path, [(1, mzxml_scan(1, 2, 400.5)), (2, mzxml_scan(2, 2)), (3, mzxml_scan(3, 2, 4.5, packed="rot13"))])
    rows = indexed.read(spark, [str(path)], "mzxml", mode="DROPMALFORMED")
    assert [r.native_id for r in xmlscan.good(rows).collect()] == [1] and xmlscan.malformed(rows).count() == 2
    with pytest.raises(Exception, match="precursorMz is missing"):
        indexed.read(spark, [str(path)], "mzxml").collect()


# --- raw blocks of many rows


def test_raw_blocks_with_few_reads(spark, tmp_path):
    rng = random.Random(2)
    texts = {"a b.xml": "".join(rng.choice("abcdé\n") for _ in range(30_000)), "c.xml": "x" * 1000}
    for n, t in texts.items():
        (tmp_path / n).write_text(t, newline="")
    raw = {n: (tmp_path / n).read_bytes() for n in texts}
    rows = [(f"file://{tmp_path}/a%20b.xml", s, s + rng.randint(0, 60), k) for k, s in enumerate(rng.sample(range(29_000), 300))]
    rows += [(f"{tmp_path}/c.xml", 10, 30, 500), (f"{tmp_path}/c.xml", 990, 5000, 501), (None, 1, 2, 502), (f"{tmp_path}/c.xml", None, 2, 503)]
    d = spark.createDataFrame(rows, "file_path string, start long, end long, k int").repartition(3)
    got = {r.k: r for r in ranges.raw_blocks(d).collect()}
    for path, a, b, k in rows:
        name = None if path is None else "a b.xml" if "a%20b" in path else "c.xml"
        assert got[k].raw == (None if None in (path, a, b) else raw[name][a:b].decode("utf-8", "replace"))
    reads = {(r.file_path, r.read_start) for r in got.values() if r.read_start is not None}
    assert len(reads) <= 12
    apart = ranges.raw_blocks(d.where("k < 300"), gap=0, most=1).select("read_start").distinct().count()
    assert apart > 150 and ranges.raw_blocks(d.limit(0)).count() == 0
    assert list(ranges.merged([(0, 10), (5, 8), (10, 20), (100, 110), (111, 300)], gap=1, most=50)) == [(0, 20, [0, 1, 2]), (100, 110, [3]), (111, 300, [4])]
