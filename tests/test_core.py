"""Parameters, column functions, similarity, clusters, refinement, enrichment, export, engine, streaming."""

import math
from dataclasses import replace
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specgraph import config
from specgraph.functions import peaks as P
from specgraph.functions import peptides
from specgraph.jobs import engine, export
from specgraph.operators import clusters, enrich, refine, similarity
from specgraph.operators import preprocess as prep
from specgraph.operators.components import connected_components
from specgraph.streaming import progressive

# --- parameters


def test_parameters_round_trip_and_check():
    p = config.parse("# all\nnum_peaks = 20 # few\ntolerance = 0.5\noutlier_thresholds = [10, 5]\n\n")
    assert (p.num_peaks, p.tolerance, p.outlier_thresholds) == (20, 0.5, (10, 5))
    assert config.parse(config.render(p)) == p
    for bad in ("tolerance = 1", "num_peaks = 192", "nothing = 1", "mz_range = (5, 1)", "num_peaks", "iden_include_decoy = 1"):
        with pytest.raises((TypeError, ValueError)):
            config.parse(bad)


# --- peaks


def spectra(spark, rows):
    return spark.createDataFrame(rows, "node_id long, mass float, charge int, peaks array<struct<mz:float,intensity:double>>")


def test_peak_functions(spark):
    d = spectra(spark, [(1, 200.0, 2, [(5.0, 1.0), (99.0, 2.0), (100.0, 3.0), (300.0, 4.0)]), (2, 10.0, 1, []), (3, 10.0, 1, [(2.0, 1.0), (2.0, 2.0)])])
    got = {
        r.node_id: r
        for r in d.select(
            "node_id", P.clip(F.col("peaks"), 5, 100).mz.alias("clip"), P.clip(F.col("peaks"), 0, 0).mz.alias("all"), P.is_ascending(F.col("peaks")).alias("up"),
            P.remove_precursor(F.col("peaks"), F.col("mass"), F.col("charge"), -1.0, 0.0, True).mz.alias("gone"), P.bin_of(F.lit(2.99), 2).alias("bin"),
        ).collect()
    }
    assert got[1].clip == [5.0, 99.0, 100.0] and len(got[1]["all"]) == 4 and got[1].gone == [5.0, 300.0] and got[1].bin == 5
    assert (got[1].up, got[2].up, got[3].up) == (True, True, False)


def test_ranks_and_ties(spark):
    rows = [(1, float(m), float(i)) for m, i in [(1.2, 5), (1.9, 5), (2.5, 10), (3.0, 7), (4.0, 10)]] + [(2, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "node_id long, mz float, intensity double")
    got = sorted(tuple(r) for r in prep.rank_transform(d, 3, 2).collect())
    assert got == [(1, 1, 1, 3), (1, 2, 2, 3), (1, 4, 3, 3)]  # three bins of intensity 10: the higher bin ranks higher
    arrays = prep.ranked_arrays(prep.rank_transform(d, 3, 2)).collect()
    assert [(a.bins, a.ranks, a.norm2) for a in arrays] == [([1, 2, 4], [1, 2, 3], 14)]


def test_mass_index_positions(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randint(0, 50))) for i in range(500)]
    d = spark.createDataFrame(rows, "native_id long, mass float").repartition(7)
    got = {r.native_id: r.position for r in prep.mass_index(d).collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((m, i) for i, m in rows))}


# --- similarity


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.0, 0.1, 1.1]))
def test_band_join_equals_theta_join(spark, seed, tolerance):
    rng = random.Random(seed)
    rows = [(i, float(np.float32(500 + rng.randint(0, 60) * 0.1))) for i in range(60)]
    d = spark.createDataFrame(rows, "node_id long, mass float")
    got = sorted(tuple(r) for r in similarity.band_pairs(d, tolerance).collect())
    near = lambda x, y: abs(np.float32(x) - np.float32(y)) <= np.float32(tolerance)
    assert got == [(i, j) for i, a in rows for j, b in rows if i < j and near(a, b)]


def random_ranked(spark, seed, n=80):
    rng = random.Random(seed)
    peaks = [(i, float(b), float(rng.randint(1, 9))) for i in range(n) for b in rng.sample(range(30), 14)]
    index = spark.createDataFrame([(i, float(np.float32(100 + rng.randint(0, 30) * 0.1))) for i in range(n)], "node_id long, mass float")
    return prep.rank_transform(spark.createDataFrame(peaks, "node_id long, mz float, intensity double"), 12, 10), index


def test_three_ways_give_the_same_edges(spark):
    ranked, index = random_ranked(spark, 4)
    arrays = {r.node_id: r for r in prep.ranked_arrays(ranked).collect()}
    mass = {r.node_id: np.float32(r.mass) for r in index.collect()}
    want = {}
    for i, a in arrays.items():
        for j, b in arrays.items():
            if i < j and abs(mass[i] - mass[j]) <= np.float32(1.1):
                other = dict(zip(b.bins, b.ranks))
                dp = sum(r * other.get(x, 0) for x, r in zip(a.bins, a.ranks)) / math.sqrt(a.norm2 * b.norm2)
                if dp > 0.6:
                    want[i, j] = dp
    assert want
    for edges in (
        similarity.dot_product_edges(ranked, index, 1.1, 0.6),
        similarity.dot_product_edges_prefix(ranked, index, 1.1, 0.6, 12),
        similarity.dot_product_edges_block(prep.ranked_arrays(ranked), index, 1.1, 0.6, 7),
    ):
        assert {(r.src, r.dst): r.dp for r in edges.collect()} == pytest.approx(want)
    audit = similarity.edge_audit(similarity.dot_product_edges(ranked, index, 1.1, 0.6), ranked, index, 1.1, 0.6).head()
    assert tuple(audit) == (len(want), 0, 0, 0)


def test_prefix_and_rank_bounds():
    assert similarity.prefix_skip(50, 0.7) == 39
    for n in (1, 10, 50):
        k = similarity.prefix_skip(n, 0.6)
        length = lambda m: m * (m + 1) * (2 * m + 1)
        assert math.sqrt(length(k) / length(n)) <= 0.6 + 1e-12 and (k == n or math.sqrt(length(k + 1) / length(n)) > 0.6)
    # The longest records allowed have a squared length that is an exact float32 whole number.
    assert 191 * 192 * 383 // 6 < 1 << 24


def test_hot_keys_are_salted(spark, monkeypatch):
    ranked, index = random_ranked(spark, 12, 60)
    index = index.withColumn("mass", F.when(F.col("node_id") % 3 > 0, F.lit(101.0)).otherwise(F.col("mass")).cast("float"))
    key = lambda df: sorted(map(tuple, df.collect()))
    ways = [lambda: similarity.band_pairs(index, 1.1), lambda: similarity.dot_product_edges(ranked, index, 1.1, 0.55), lambda: similarity.dot_product_edges_prefix(ranked, index, 1.1, 0.55, 12)]
    plain = [key(w()) for w in ways]
    monkeypatch.setattr(similarity, "SALT_ROWS", 6)
    assert [key(w()) for w in ways] == plain and all(plain)


def test_edges_of_a_hot_mass_come_from_many_blocks(spark):
    ranked, index = random_ranked(spark, 9, 90)
    index = index.withColumn("mass", F.when(F.col("node_id") % 3 > 0, F.lit(101.0)).otherwise(F.col("mass")).cast("float"))
    arrays = prep.ranked_arrays(ranked)
    blocks = similarity._blocks(arrays.join(index, "node_id").withColumn("bucket", similarity._bucket(F.col("mass"), 1.1)), 8)
    assert max(len(r.rows) for r in blocks.collect()) <= 24 and blocks.count() >= 8
    key = lambda df: sorted((r.src, r.dst) for r in df.collect())
    whole = key(similarity.dot_product_edges(ranked, index, 1.1, 0.55))
    assert key(similarity.dot_product_edges_block(arrays, index, 1.1, 0.55, 8)) == whole and whole
    records = arrays.join(index, "node_id")
    fresh, known = records.where("node_id >= 60"), records.where("node_id < 60")
    between = key(similarity.edges_between(fresh, known, 1.1, 0.55, 8))
    assert between == [(a, b) for a, b in whole if (a >= 60) != (b >= 60)] and between


# --- graphs


def union_find(pairs):
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(150)], [(0, i) for i in range(1, 200)], [(5, 5), (1, 2), (2, 1), (9, 8)], None])
def test_components(spark, pairs):
    if pairs is None:
        rng = random.Random(2)
        pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)]
    d = spark.createDataFrame([*pairs, (None, 3), (4, None)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(d).collect()} == union_find(pairs)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def dbscan_plain(pairs, min_points):
    beside: dict = {}
    for a, b in pairs:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    core = {x for x, y in beside.items() if len(y) >= min_points - 1}
    label = union_find([(a, b) for a, b in pairs if a in core and b in core] + [(c, c) for c in core])
    for x, y in beside.items():
        if x not in core and y & core:
            label[x] = label[min(y & core)]
    sizes: dict = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    return {x: c for x, c in label.items() if sizes[c] > 1}


@pytest.mark.parametrize("min_points", [2, 3, 5])
def test_dbscan(spark, min_points):
    rng = random.Random(min_points)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)})
    d = spark.createDataFrame([(a, b, 0.9) for a, b in pairs], "src long, dst long, dp double")
    assert {r.node_id: r.cluster_id for r in clusters.dbscan(d, min_points).collect()} == dbscan_plain(pairs, min_points)


RINGS = [(i, (i + 1) % 8) for i in range(8)] + [(8 + i, 8 + (i + 1) % 8) for i in range(8)] + [(16, 0), (16, 4), (16, 8), (16, 12)]
CLIQUES = [(i, j) for i in range(5) for j in range(i)] + [(5 + i, 5 + j) for i in range(5) for j in range(i)] + [(10, 0), (10, 5)]


def plain_betweenness(n, pairs):
    """Shortest paths counted for every pair."""
    beside = [[] for _ in range(n)]
    for a, b in pairs:
        beside[a].append(b)
        beside[b].append(a)

    def paths(s, t):
        level, found = [[s]], []
        while level and not found:
            level = [[*p, x] for p in level for x in beside[p[-1]] if x not in p]
            found = [p for p in level if p[-1] == t]
        return found

    out = np.zeros(n)
    for s in range(n):
        for t in range(s):
            found = paths(s, t)
            for p in found:
                for x in p[1:-1]:
                    out[x] += 1 / len(found)
    return out


@pytest.mark.parametrize("pairs,n", [(RINGS, 17), (CLIQUES, 11), ([(0, 1), (1, 2), (2, 3)], 4), ([(0, i) for i in range(1, 6)], 6)])
def test_betweenness(pairs, n):
    src, dst = np.array(pairs).T
    assert np.allclose(refine.betweenness(n, src, dst), plain_betweenness(n, pairs))


def test_refinement(spark):
    rows = [(1, a, b) for a, b in RINGS] + [(100, a + 100, b + 100) for a, b in CLIQUES]
    d = spark.createDataFrame(rows, "cluster_id long, src long, dst long")
    split = {}
    for r in refine.refine(d, (10,)).collect():
        split.setdefault((r.raw_cluster_id, r.cluster_id), set()).add(r.node_id)
    assert split == {(1, 0): set(range(8)), (1, 8): set(range(8, 16)), (100, 100): set(range(100, 111))}
    assert {r.node_id for r in refine.refine(d.where("cluster_id = 1"), (20,)).collect()} == set(range(17))
    assert refine.refine(d, (10, 1)).count() <= 27
    assert sorted(map(tuple, refine.refine(d, (10,), max_edges=19).collect())) == sorted(map(tuple, refine.refine(d, (10,)).collect()))
    left = sorted(map(tuple, refine.refine(d, (10,), max_edges=19, leave_large=True).collect()))
    assert left == [(1, i, 1) for i in range(17)] + [(100, 100 + i, 100) for i in range(11)]


def test_large_clusters_are_dealt_over_tasks(spark):
    """The same betweenness and the same clusters whether a cluster's sources stay in one task or go to many."""
    rng = np.random.default_rng(5)
    rows = [(1, a, b) for a, b in RINGS] + [(100, a + 100, b + 100) for a, b in CLIQUES]
    for c in range(200, 500, 100):
        part = rng.integers(0, 3, 60)
        pairs = {(i, j) for i in range(60) for j in range(i) if rng.random() < (0.15 if part[i] == part[j] else 0.01)} | {(i, i - 1) for i in range(1, 60)}
        rows += [(c, c + i, c + j) for i, j in pairs]
    d = spark.createDataFrame(rows, "cluster_id long, src long, dst long")
    one, many = ({(r.cluster_id, r.node_id): r.betweenness for r in refine.cluster_betweenness(d, work=w).collect()} for w in (refine.WORK, 200))
    assert one.keys() == many.keys() and np.allclose(list(one.values()), [many[k] for k in one])
    for thresholds in ((3,), (5, 3)):
        whole, dealt = (sorted(map(tuple, refine.refine(d, thresholds, work=w).collect())) for w in (refine.WORK, 700))
        assert whole == dealt and len(whole) > 0


@pytest.mark.parametrize("fan,pack,state", [(4096, 250_000, 10**9), (2, 7, 700)])
def test_clusters_that_no_task_holds(spark, monkeypatch, fan, pack, state):
    """Levels as joins give Brandes' numbers: hubs cut over rows, sources in batches, some clusters by shares beside them."""
    monkeypatch.setattr(refine, "FAN", fan)
    monkeypatch.setattr(refine, "PACK", pack)
    rng = np.random.default_rng(9)
    rows = [(1, a, b) for a, b in RINGS] + [(100, a + 100, b + 100) for a, b in CLIQUES] + [(300, 300, 300 + i) for i in range(1, 12)] + [(400, 400, 401), (400, 401, 402)]
    pairs = {(int(i), int(j)) for i, j in rng.integers(0, 25, (90, 2)) if i < j}
    rows += [(500, 500 + i, 500 + j) for i, j in pairs]
    d = spark.createDataFrame(rows, "cluster_id long, src long, dst long")
    got = {(r.cluster_id, r.node_id): r.betweenness for r in refine.cluster_betweenness(d, work=100, max_edges=12, state=state).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = np.array([r[1:] for r in rows if r[0] == c])
        ids = np.unique(own)
        b = refine.betweenness(len(ids), np.searchsorted(ids, own[:, 0]), np.searchsorted(ids, own[:, 1]))
        want |= {(c, int(i)): x for i, x in zip(ids, b)}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    if fan > 2:
        plain = sorted(map(tuple, refine.refine(d, (10, 3)).collect()))
        assert sorted(map(tuple, refine.refine(d, (10, 3), work=100, max_edges=12, state=state).collect())) == plain != []


# --- identifications and text


def test_peptide_texts(spark):
    row = ("PEK", [(3, 128.1), (1, 97.05)], 43.0, None)
    d = spark.createDataFrame([row, ("A", None, 0.0, 17.5), ("", [], None, None)], "p string, mods array<struct<pos:int,mass:double>>, n double, c double")
    args = [F.col(x) for x in ("p", "mods", "n", "c")]
    got = d.select(peptides.with_masses(*args).alias("a"), peptides.with_integer_masses(*args).alias("b")).collect()
    assert [tuple(r) for r in got] == [("n[43.0]P[97.05]EK[128.1]", "n[43]P[97]EK[128]"), ("Ac[17.5]", "Ac[17]"), ("", "")]
    shown = d.limit(1).select(peptides.display(F.col("p"), F.lit(2), F.lit(0.5), F.lit(True), F.lit("K"), F.lit(None).cast("string")).alias("t")).head()
    assert shown.t == "DECOY_K.PEK./2 (0.5)"
    back = spark.createDataFrame([("a:1;b:c:2",), ("",)], "t string").select(peptides.histogram_map(F.col("t")).alias("m")).collect()
    assert [r.m for r in back] == [{"a": 1, "b:c": 2}, {}]


def test_enrichment_and_entropy(spark):
    member = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (6, 6)], "cluster_id long, node_id long")
    index = spark.createDataFrame([(i, float(i), "f", i) for i in range(1, 7)], "node_id long, mass float, file_stem string, native_id long")
    idens = spark.createDataFrame([("f", 1, "A", 2, 0.9, False), ("f", 2, "A", 2, 0.9, False), ("f", 3, "B", 2, 0.9, False), ("f", 4, "A", 2, 0.9, False), ("f", 5, "C", 1, 0.9, True)], "ms_file string, native_id long, peptide string, charge int, probability double, is_decoy boolean")
    got = {r.cluster_id: r for r in enrich.enrich(member, index, idens).collect()}
    assert (got[1].idens, got[1].major_iden, got[1].num_idens, got[1].iden_ratio, got[1].mass_avg) == ("A/2:2;B/2:1", "A/2", 2, 1.0, 2.0)
    assert (got[4].idens, got[4].iden_ratio, got[6].num_idens, got[6].major_iden, got[6].iden_ratio) == ("A/2:1", 0.5, 0, None, 0.0)
    inside, across = (e.head().entropy for e in enrich.entropies(enrich.named_members(member, index, idens)))
    h = lambda *p: -sum(x * math.log2(x) for x in p)
    assert inside == pytest.approx((3 * h(2 / 3, 1 / 3) + 0) / 4) and across == pytest.approx(3 * h(2 / 3, 1 / 3) / 4)
    none = enrich.named_members(member, index, idens.limit(0))
    assert [e.head().entropy for e in enrich.entropies(none)] == [None, None]


def test_modified_peptides_count_apart(spark):
    member = spark.createDataFrame([(1, i) for i in range(1, 6)], "cluster_id long, node_id long")
    index = spark.createDataFrame([(i, float(i), "f", i) for i in range(1, 6)], "node_id long, mass float, file_stem string, native_id long")
    rows = [("f", 1, "PEPM", 2, 0.9, False, [], None, None), ("f", 2, "PEPM", 2, 0.9, False, [(4, 147.04)], None, None), ("f", 3, "PEPM", 2, 0.9, False, [(4, 147.04)], None, None), ("f", 4, "PEPM", 2, 0.9, False, None, 43.5, 17.2)]
    idens = spark.createDataFrame(rows, "ms_file string, native_id long, peptide string, charge int, probability double, is_decoy boolean, mods array<struct<pos:int,mass:double>>, nterm_mod double, cterm_mod double")
    got = enrich.enrich(member, index, idens).head()
    assert (got.idens, got.num_idens, got.major_iden, got.iden_ratio) == ("PEPM[147]/2:2;PEPM/2:1;n[43]PEPMc[17]/2:1", 3, "PEPM[147]/2", 0.8)


def test_export_layout(spark, tmp_path):
    c = spark.createDataFrame([(1, 2, 1, 1, "A/2", 0.5, 4.5), (5, 2, 0, 0, None, 0.0, 4.0)], "cluster_id long, num_nodes long, num_edges long, num_idens int, major_iden string, iden_ratio double, mass_avg double")
    n = spark.createDataFrame([(1, 2, "g", 1, None, None), (1, 1, "f", 9, "A/2", 0.9), (7, 3, "f", 9, None, None), (5, 8, "f", 10, None, None)], "cluster_id long, node_id long, file_stem string, native_id long, iden string, probability double")
    e = spark.createDataFrame([(1, 1, 2, 0.75)], "cluster_id long, src long, dst long, dp double")
    lines = export.cluster_lines(c, n, e)
    one = "# Cluster\n1\t2\t1\t1\tA/2\t0.5\t4.5\n# Nodes\n1\tf\t9\tA/2\t0.9\n2\tg\t1\tNone\tNone\n# Edges\n1\t2\t0.75000000\n\n"
    two = "# Cluster\n5\t2\t0\t0\tNone\t0.0\t4.0\n# Nodes\n8\tf\t10\tNone\tNone\n# Edges\n\n"
    assert "".join(r.line + "\n" for r in lines.orderBy("cluster_id", "place").collect()) == one + two
    head = "# Columns\n# Cluster\nID\tNum of nodes\tNum of edges\tNum of identifications\tMajor identification\tIdentified ratio\tAverage precursor mass\n# Nodes\nID\tFile\tScan num\tIdentification\tProbability\n# Edges\nID of source\tID of target\tDot product\n\n# Clusters\n"
    text = lambda folder: "".join(f.read_text() for f in sorted(folder.glob("part-*")))
    export.write_lines(lines, str(tmp_path / "out"))
    assert text(tmp_path / "out") == head + one + two
    for k in (5, 1):
        export.append_lines(lines.where(F.col("cluster_id") == k), str(tmp_path / "some"))
    assert text(tmp_path / "some") == head + two + one  # the header once, then what was added in order
    export.write_lines(lines, str(tmp_path / "some"))
    assert text(tmp_path / "some") == head + one + two
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "thesis.txt").write_text("x")
    for put in (export.write_lines, export.append_lines):
        with pytest.raises(ValueError, match="holds other files"):
            put(lines, str(tmp_path / "mine"))
    assert (tmp_path / "mine" / "thesis.txt").read_text() == "x"


def test_stored_identifications_and_updates(spark):
    idens = spark.createDataFrame([("f", 1, "A", 2, 0.95, False, 0, 1), ("f", 1, "B", 2, 0.99, False, 0, 2), ("f", 1, "C", 2, 0.99, False, 1, 9), ("f", 2, "D", 3, 0.5, False, 0, 3), ("f", 3, "E", 3, 0.97, True, 0, 4)], "ms_file string, native_id long, peptide string, charge int, probability double, is_decoy boolean, iden_file_id int, position long")
    kept = enrich.stored_identifications(idens, spark)
    assert [(r.native_id, r.peptide, r.mods) for r in kept.collect()] == [(1, "B", None)]
    assert enrich.stored_identifications(None, spark).count() == 0 and enrich.stored_identifications(None, spark).columns == kept.columns
    member = spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "cluster_id long, node_id long")
    index = spark.createDataFrame([(i, float(i), "f", i) for i in (1, 2, 3)], "node_id long, mass float, file_stem string, native_id long")
    first = enrich.enrich(member, index, kept)
    later = enrich.stored_identifications(idens.withColumn("peptide", F.lit("Z")), spark, 0.1, True).withColumn("is_decoy", F.lit(False))
    major = lambda df: {r.cluster_id: r.major_iden for r in df.collect()}
    assert major(first) == {1: "B/2", 3: None}
    assert major(enrich.update_enrichment(first, member, index, later)) == {1: "B/2", 3: "Z/3"}
    assert major(enrich.update_enrichment(first, member, index, later, update=True)) == {1: "Z/2", 3: "Z/3"}


# --- storage


def test_scratch_tables_go(spark):
    from specgraph import storage

    with storage.scratch():
        with storage.scratch():
            gone = storage.write(spark.range(3), "a")
            kept = storage.write(spark.range(4), "b", keep=True)
            assert gone.df.count() == 3
        assert kept.df.count() == 4
        with pytest.raises(Exception):  # noqa: B017
            storage.Written(spark, gone.path, spark.range(1).schema).df.count()
    outer = storage.write(spark.range(5), "c")
    with storage.scratch():
        result = storage.write(spark.range(6), "d", keep=True)
    assert outer.df.count() == 5 and result.df.count() == 6


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from specgraph import storage

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(applicationId="x", master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        storage.shared_dir(far)


# --- runs


def test_engine_reuses_stages(spark, tmp_path):
    ranked, index = random_ranked(spark, 8, 40)
    rng = random.Random(8)
    peaks = spark.createDataFrame([(i, float(b), float(rng.randint(1, 9))) for i in range(40) for b in rng.sample(range(30), 14)], "node_id long, mz float, intensity double")
    index = index.withColumns({"charge": F.lit(1), "file_stem": F.lit("f"), "native_id": F.col("node_id")})
    idens = spark.createDataFrame([("f", 1, "A", 2, 0.95, False, 0, 1)], "ms_file string, native_id long, peptide string, charge int, probability double, is_decoy boolean, iden_file_id int, position long")
    params = config.Params(num_peaks=12, dp_threshold=0.5)
    run = engine.Engine(spark, str(tmp_path / "a"), index, peaks, idens, params)
    assert run.stage("enriched").count() == run.stage("members").select("cluster_id").distinct().count() > 0
    before = dict(run.manifest["stages"])
    again = engine.Engine(spark, str(tmp_path / "a"), index, peaks, idens, params).load()
    assert again.manifest["stages"] == before
    fork = run.fork(str(tmp_path / "b"), config.Params(num_peaks=12, dp_threshold=0.7))
    assert set(fork.manifest["stages"]) == {"index", "ranked", "idens"}
    assert fork.stage("edges").count() < run.stage("edges").count()
    # A parameter of a stage runs it and what follows from it again, and changes its rows.
    assert set(run.fork(str(tmp_path / "c"), replace(params, mz_range=(5, 300))).manifest["stages"]) == {"index", "idens"}
    other = run.fork(str(tmp_path / "d"), replace(params, mz_range=(5, 18), min_bins=3))
    assert max(max(r.bins) for r in other.stage("ranked").collect()) == 18 < max(max(r.bins) for r in run.stage("ranked").collect())
    near = run.fork(str(tmp_path / "e"), replace(params, removal_range=(-200.0, -88.0), min_bins=3))
    assert min(min(r.bins) for r in near.stage("ranked").collect()) >= 12
    assert run.fork(str(tmp_path / "f"), replace(params, min_scan_peaks=1000)).stage("index").count() == 0
    assert run.fork(str(tmp_path / "g"), replace(params, true_precursor_mass=True)).stage("index").count() == 40
    # Only what was asked for is there, and it is reused by itself; another run in the same folder takes it over.
    lone = engine.Engine(spark, str(tmp_path / "h"), index, peaks, None, params)
    lone.stage("ranked")
    assert set(lone.fork(str(tmp_path / "i"), params).manifest["stages"]) == {"index", "ranked"}
    assert lone.stage("enriched").agg({"num_idens": "sum"}).head()[0] == 0
    again = engine.Engine(spark, str(tmp_path / "h"), params=params).load()
    assert again.stage("enriched").count() == lone.stage("enriched").count() and again._inputs is None
    assert "ranked" not in engine.Engine(spark, str(tmp_path / "h"), params=params, label=["other"]).load().manifest["stages"]
    run.views("t_")
    assert spark.sql("select count(*) c from t_edges").head().c == run.stage("edges").count()
    nodes, edges = run.cluster(run.stage("members").head().cluster_id)
    assert nodes.count() > 1 and edges.count() > 0


def test_progressive_edges_equal_batch_edges(spark, tmp_path):
    ranked, index = random_ranked(spark, 5, 60)
    records = prep.ranked_arrays(ranked).join(index, "node_id").select("node_id", "mass", "n", "norm2", "bins", "ranks")
    source = str(tmp_path / "in")
    for k in range(3):
        records.where(F.col("node_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(progressive.RECORD).option("maxFilesPerTrigger", 1).parquet(source)
    q = progressive.start(stream, str(tmp_path / "root"), str(tmp_path / "ck"), 1.1, 0.6)
    q.processAllAvailable()
    q.stop()
    got = sorted((r.src, r.dst) for r in progressive.read(spark, str(tmp_path / "root"), "edges").collect())
    want = sorted((r.src, r.dst) for r in similarity.dot_product_edges_block(prep.ranked_arrays(ranked), index, 1.1, 0.6).collect())
    assert got == want and want


def test_labels_follow_each_batch(spark, tmp_path):
    """After every batch the labels are those of a full run; rows rewritten are those of clusters that got another name, and new nodes."""
    from specgraph import storage
    from specgraph.operators import clusters

    ranked, index = random_ranked(spark, 5, 60)
    records = prep.ranked_arrays(ranked).join(index, "node_id").select("node_id", "mass", "n", "norm2", "bins", "ranks")
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    there = set(storage.names(spark, f"{storage.shared_dir(spark)}/tables"))
    before, merged = {}, 0
    for k in (3, 1, 2, 0):
        records.where(F.col("node_id") % 4 == k).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(progressive.RECORD).parquet(source)
        q = progressive.start(stream, root, str(tmp_path / "ck"), 1.1, 0.55, together=2)
        q.processAllAvailable()
        q.stop()
        now = {r.node_id: r.cluster_id for r in progressive.labels(spark, root).collect()}
        assert now == {r.node_id: r.cluster_id for r in clusters.members(progressive.read(spark, root, "edges")).collect()}
        last = progressive.read(spark, root, "labels").agg(F.max("batch")).head()[0]
        written = {r.node_id for r in progressive.read(spark, root, "labels").where(F.col("batch") == last).collect()} if last is not None else set()
        changed = {i for i, c in now.items() if before.get(i) != c}
        assert written == changed
        merged += sum(i in before for i in changed)
        before = now
    assert len(before) > 10 and merged > 0
    assert any(n.startswith("base-") for n in storage.names(spark, f"{root}/labels")) and len(storage.names(spark, f"{root}/records")) <= 3
    for name in set(storage.names(spark, f"{storage.shared_dir(spark)}/tables")) - there:
        assert not name.startswith("blocks")


def test_label_changes_of_merged_clusters(spark):
    known = spark.createDataFrame([(i, 0) for i in (0, 1, 2)] + [(i, 10) for i in (10, 11)] + [(i, 20) for i in (20, 21)], "node_id long, cluster_id long")
    edges = spark.createDataFrame([(2, 11, 0.9), (30, 21, 0.9), (40, 41, 0.9), (0, 1, 0.9)], "src long, dst long, dp double")
    got = {(r.node_id, r.cluster_id) for r in progressive.label_changes(edges, known).collect()}
    assert got == {(10, 0), (11, 0), (30, 20), (40, 40), (41, 40)}
    assert progressive.label_changes(edges.limit(0), known).count() == 0
    assert {r.cluster_id for r in progressive.label_changes(spark.createDataFrame([(5, 20, 0.9)], "src long, dst long, dp double"), known).collect()} == {5}


def test_packed_adjacency(spark):
    from specgraph.operators import clusters

    rows = [(1, 1, j, j / 100) for j in range(2, 60)] + [(1, a, a + 1, 0.5) for a in range(2, 40)] + [(100, 100, 101, 0.25)]
    d = spark.createDataFrame(rows, "cluster_id long, src long, dst long, dp double")
    for packed in (10, 10**6):
        table = clusters.adjacency(d, packed)
        assert sorted(map(tuple, clusters.unpacked(table).collect())) == sorted(rows)
        assert table.count() == (2 if packed > 10 else table.count()) and all(len(r.offsets) == len(r.nodes) + 1 and len(r.others) < 30 for r in table.collect() if packed == 10)
    assert clusters.unpacked(clusters.adjacency(d.limit(0))).count() == 0


# --- fragment ions


def test_fragment_ions(spark):
    """Known masses of PEPTIDE, and a plain version with modifications, ends and charges."""
    from specgraph.functions import ions

    schema = "k int, peptide string, mods array<struct<pos:int,mass:double>>, nterm_mod double, cterm_mod double, charge int"
    rows = [(1, "PEPTIDE", None, None, None, 1), (2, "AMCK", [(2, 147.0354), (3, 160.0307)], 43.0184, 18.0, 3), (3, "AXKR", [], 0.0, 0.0, 2), (4, "K", [], None, None, 2), (5, None, None, None, None, 2), (6, "AK", [], None, None, None), (7, "", [], None, None, 1)]
    got = {(r.k, r.ion): r.mz for r in ions.fragment_ions(spark.createDataFrame(rows, schema)).collect()}
    known = {"b2+": 227.10263, "b6+": 653.31407 - 1e-9, "y1+": 148.06044, "y6+": 703.31482, "a2+": 199.10772}
    for name, mz in known.items():
        assert abs(got[1, name] - mz) < 2e-3, name

    def plain(peptide, mods, n, c, charge):
        own = [dict(mods or []).get(i + 1, ions.RESIDUES.get(r)) for i, r in enumerate(peptide)]
        out = {}
        for s, (end, plus) in ions.SERIES.items():
            for i in range(1, len(own)):
                part = own[:i] if end == "prefix" else own[-i:]
                first = (n - ions.HYDROGEN if n else 0) if end == "prefix" else (c - ions.WATER + ions.HYDROGEN if c else 0)
                for z in range(1, charge + 1):
                    if None not in part:
                        out[f"{s}{i}" + "+" * z] = (sum(part) + first + plus + z * ions.PROTON) / z
        return out

    want = {(k, name): mz for k, *rest in rows if rest[0] and rest[-1] for name, mz in plain(*rest).items()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    assert not any(k in (4, 5, 6, 7) for k, _ in got) and (3, "b1+") in got and (3, "b2+") not in got and (3, "y2++") in got
    peaks = spark.createDataFrame([(1, 227.9, 2.0), (1, 227.1, 3.0), (1, 500.0, 1.0), (2, 227.0, 1.0)], "node_id int, mz double, intensity double")
    named = ions.annotated_peaks(peaks, ions.fragment_ions(spark.createDataFrame(rows[:1], schema)).withColumnRenamed("k", "node_id"))
    assert [tuple(r) for r in named.collect()] == [(1, 227, 5.0, ["b2+"])]
    assert ions.fragment_ions(spark.createDataFrame([], schema)).count() == 0


# --- table functions


def test_table_functions(spark):
    """The functions of SQL give what those on DataFrames give, partitioned by themselves."""
    from specgraph.jobs import sqlfunctions
    from specgraph.operators import clusters

    sqlfunctions.register(spark)
    rng = np.random.default_rng(11)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (60, 2)) if a != b}
    rows = [(a, b, 0.9) for a, b in pairs] + [(a + 100, b + 100, 0.9) for a, b in RINGS]
    edges = spark.createDataFrame(rows, "src long, dst long, dp double")
    inside = clusters.inner_edges(edges, clusters.members(edges))
    inside.createOrReplaceTempView("inside")
    found = lambda q: sorted(map(tuple, spark.sql(q).collect()))
    for least in (2, 3, 4):
        assert found(f"SELECT * FROM dbscan(TABLE(inside), {least})") == sorted(map(tuple, clusters.dbscan(edges, least).collect())) != []
    want = {(r.cluster_id, r.node_id): r.betweenness for r in refine.cluster_betweenness(inside).collect()}
    got = {(a, b): x for a, b, x in found("SELECT * FROM betweenness(TABLE(inside))")}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    assert found("SELECT * FROM refined(TABLE(inside), '10')") == sorted(map(tuple, refine.refine(inside, (10,)).collect()))
    named = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (2, "c"), (2, "c"), (3, None)], "cluster_id long, iden string")
    named.createOrReplaceTempView("named")
    assert [(a, n, round(x, 6)) for a, n, x in found("SELECT * FROM iden_entropy(TABLE(named))")] == [(1, 3, 0.918296), (2, 2, 0.0)]
    total = spark.sql("SELECT sum(entropy * n) / sum(n) x FROM iden_entropy(TABLE(named))").head().x
    assert total == pytest.approx(enrich.entropies(named)[0].head().entropy)
    with pytest.raises(Exception, match="lacks src, dst"):
        spark.sql("SELECT * FROM dbscan(TABLE(named), 3)").collect()
    with pytest.raises(Exception, match="whole numbers"):
        spark.sql("SELECT * FROM refined(TABLE(inside), 'ten')").collect()
