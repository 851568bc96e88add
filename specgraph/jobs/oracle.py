"""SQL that each registered query is held against, in parts that are put together by name."""

from __future__ import annotations

from specgraph.functions import ions

TOL, T, N, LEAST = 1.1, 0.5, 20, 10

PARTS = {
    "part_peaks": "SELECT l_partkey AS node_id, CAST(l_quantity AS FLOAT) AS mz, CAST(l_extendedprice AS DOUBLE) AS intensity FROM lineitem",
    "part_index": "SELECT p_partkey AS node_id, CAST(p_retailprice AS FLOAT) AS mass, CAST(1 + p_size % 3 AS INTEGER) AS charge, 'f' || CAST(p_partkey % 5 AS VARCHAR) AS file_stem, p_partkey AS native_id FROM part",
    "user_peaks": "SELECT user_id AS node_id, CAST(value AS FLOAT) AS mz, CAST(event_id % 1000 + 1 AS DOUBLE) AS intensity FROM events",
    "user_index": "SELECT node_id, CAST(400 + (node_id % 40) * 0.5 AS FLOAT) AS mass, CAST(1 + node_id % 3 AS INTEGER) AS charge FROM (SELECT DISTINCT user_id AS node_id FROM events)",
    "idens": """SELECT 'f' || CAST(p_partkey % 5 AS VARCHAR) AS ms_file, p_partkey AS native_id, p_brand AS peptide, CAST(1 + p_size % 3 AS INTEGER) AS charge,
        (p_partkey * 37) % 1000 / 1000.0::DOUBLE AS probability, p_partkey % 13 = 0 AS is_decoy, 0 AS iden_file_id, p_partkey AS position FROM part
        UNION ALL SELECT 'f' || CAST(p_partkey % 5 AS VARCHAR), p_partkey, p_brand || 'x', CAST(1 + p_size % 3 AS INTEGER),
        (p_partkey * 37) % 1000 / 1000.0::DOUBLE, p_partkey % 13 = 0, 1, p_partkey + 1 FROM part WHERE p_partkey % 3 = 0""",
    "modified": """SELECT *, CASE WHEN native_id % 6 = 0 THEN 'n[43]' ELSE '' END || CASE WHEN native_id % 4 = 0 THEN substr(peptide, 1, CAST(1 + native_id % 3 AS INTEGER)) || '[' || CAST(100 + native_id % 2 AS VARCHAR) || ']' || substr(peptide, CAST(2 + native_id % 3 AS INTEGER))
        ELSE peptide END || CASE WHEN native_id % 10 = 0 THEN 'c[17]' ELSE '' END || '/' || CAST(charge AS VARCHAR) AS iden FROM usable""",
    "usable": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY ms_file, native_id ORDER BY iden_file_id, position DESC) AS rn FROM idens WHERE probability >= 0.1) WHERE rn = 1 AND NOT is_decoy",
    "both_ways": "SELECT src AS node_id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges",
    "members": "SELECT min(other) AS cluster_id, node_id FROM reach GROUP BY node_id",
    "inside": "SELECT a.cluster_id, e.src, e.dst, e.dp FROM edges e JOIN members a ON a.node_id = e.src",
    "named": "SELECT m.cluster_id, m.node_id, i.mass, u.iden, u.probability FROM members m JOIN part_index i USING (node_id) LEFT JOIN modified u ON u.ms_file = i.file_stem AND u.native_id = i.native_id",
}


def ranked(peaks: str, n: int = N, bins: int = 1) -> str:
    return f"""binned AS (SELECT node_id, CAST(trunc(mz * CAST({bins} AS FLOAT)) AS INTEGER) AS bin, sum(intensity) AS intensity FROM {peaks} GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY intensity DESC, bin DESC) AS rn, least(count(*) OVER (PARTITION BY node_id), {n}) AS n FROM binned),
ranked AS (SELECT node_id, bin, CAST(n - rn + 1 AS INTEGER) AS rank, CAST(n AS INTEGER) AS n FROM ordered WHERE rn <= {n} AND n >= {LEAST})"""


def scored(index: str) -> str:
    """All pairs within the tolerance that share a bin, with their dot product."""
    return f"""scored AS (SELECT a.node_id AS src, b.node_id AS dst, any_value(i.mass) AS m_a, any_value(j.mass) AS m_b,
 CAST(sum(CAST(a.rank AS BIGINT) * b.rank) AS BIGINT) / sqrt(CAST(any_value((CAST(a.n AS BIGINT)*(a.n+1)*(2*a.n+1)//6) * (CAST(b.n AS BIGINT)*(b.n+1)*(2*b.n+1)//6)) AS DOUBLE)) AS dp
 FROM {index} i JOIN {index} j ON i.node_id < j.node_id AND abs(i.mass - j.mass) <= CAST({TOL} AS FLOAT)
 JOIN ranked a ON a.node_id = i.node_id JOIN ranked b ON b.node_id = j.node_id AND a.bin = b.bin GROUP BY ALL)"""


def parts(*names: str) -> str:
    return ",\n".join(f"{n} AS ({PARTS[n]})" for n in names)


RANKED_PARTS = parts("part_peaks", "part_index") + ",\n" + ranked("part_peaks")
EDGES = RANKED_PARTS + ",\n" + scored("part_index") + f",\nedges AS (SELECT src, dst, dp FROM scored WHERE dp > {T})"
USER_EDGES = parts("user_peaks", "user_index") + ",\n" + ranked("user_peaks", 50) + ",\n" + scored("user_index") + f",\nedges AS (SELECT src, dst, dp FROM scored WHERE dp > {T})"


def reach(source: str = "both_ways") -> str:
    return f"reach(node_id, other) AS (SELECT node_id, node_id FROM {source} UNION SELECT r.node_id, b.other FROM reach r JOIN {source} b ON b.node_id = r.other)"


CLUSTERS = EDGES + ",\n" + parts("both_ways") + ",\n" + reach() + ",\n" + parts("members", "inside")
NAMED = CLUSTERS + ",\n" + parts("idens", "usable", "modified", "named")


def with_(head: str, body: str) -> str:
    return f"WITH RECURSIVE {head}\n{body}"


ENRICHED = """totals AS (SELECT cluster_id, count(*) AS num_nodes, count(iden) AS named_nodes, avg(CAST(mass AS DOUBLE)) AS mass_avg FROM named GROUP BY ALL),
counts AS (SELECT cluster_id, iden, count(*) AS n FROM named WHERE iden IS NOT NULL GROUP BY ALL),
lists AS (SELECT cluster_id, count(*) AS num_idens, string_agg(iden || ':' || CAST(n AS VARCHAR), ';' ORDER BY n DESC, iden) AS idens, arg_min(iden, (-n, iden)) AS major_iden FROM counts GROUP BY ALL)"""

POINTS = """degree AS (SELECT node_id, count(*) AS degree FROM both_ways GROUP BY ALL),
core AS (SELECT node_id FROM degree WHERE degree >= 2),
types AS (SELECT d.node_id, d.degree, CASE WHEN d.degree >= 2 THEN 2 WHEN EXISTS (SELECT 1 FROM both_ways b JOIN core c ON c.node_id = b.other WHERE b.node_id = d.node_id) THEN 1 ELSE 0 END AS point_type FROM degree d),
core_ways AS (SELECT b.node_id, b.other FROM both_ways b JOIN core c ON c.node_id = b.node_id JOIN core d ON d.node_id = b.other UNION ALL SELECT node_id, node_id FROM core)"""

DBSCAN = """core_labels AS (SELECT min(other) AS cluster_id, node_id FROM reach GROUP BY node_id),
borders AS (SELECT b.node_id, min(b.other) AS core FROM both_ways b JOIN core c ON c.node_id = b.other JOIN types t ON t.node_id = b.node_id AND t.point_type = 1 GROUP BY ALL),
assigned AS (SELECT cluster_id, node_id, 2 AS point_type FROM core_labels UNION ALL SELECT l.cluster_id, b.node_id, 1 FROM borders b JOIN core_labels l ON l.node_id = b.core)"""


def entropy(group: str) -> str:
    return f"""counts AS (SELECT cluster_id, iden, count(*) AS n FROM named WHERE iden IS NOT NULL GROUP BY ALL),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY {group}) AS p FROM counts),
per AS (SELECT {group}, sum(-p * log2(p)) AS h, sum(n) AS n FROM shares GROUP BY ALL)
SELECT round(sum(h * n) / sum(n), 6) AS entropy FROM per"""


PEPTIDES = """peps AS (SELECT p_partkey AS native_id, replace(p_brand, '#', '') AS peptide, CAST(1 + p_size % 3 AS INTEGER) AS charge, (p_partkey * 37) % 1000 / 1000.0::DOUBLE AS probability,
 p_partkey % 13 = 0 AS is_decoy, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'K' END AS prev_aa, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'R' END AS next_aa,
 CASE WHEN p_partkey % 3 = 0 THEN 43.5 WHEN p_partkey % 3 = 1 THEN 0.0 END AS nterm, CAST(CASE WHEN p_partkey % 7 = 0 THEN 17.25 END AS DOUBLE) AS cterm, 1 + p_partkey % 3 AS pos, 100.0 + p_size + 0.5 AS modmass FROM part)"""


def peptide(number: str) -> str:
    return f"""SELECT native_id, CASE WHEN coalesce(nterm, 0) <> 0 THEN 'n[' || {number.format('nterm')} || ']' ELSE '' END || substr(peptide, 1, pos) || '[' || {number.format('modmass')} || ']' || substr(peptide, pos + 1)
 || CASE WHEN coalesce(cterm, 0) <> 0 THEN 'c[' || {number.format('cterm')} || ']' ELSE '' END AS text FROM peps"""


def betweenness_of(k: int) -> str:
    """bet{k}(cluster_id, node_id, betweenness) of edges{k}(cluster_id, src, dst): every shortest path is walked, so clusters must be small."""
    return f"""ways{k} AS (SELECT cluster_id, src AS a, dst AS b FROM edges{k} UNION ALL SELECT cluster_id, dst, src FROM edges{k}),
walks{k}(cluster_id, s, t, path) AS (SELECT DISTINCT cluster_id, a, a, [a] FROM ways{k} UNION ALL SELECT w.cluster_id, w.s, v.b, list_append(w.path, v.b) FROM walks{k} w JOIN ways{k} v ON v.a = w.t WHERE NOT list_contains(w.path, v.b)),
best{k} AS (SELECT * FROM (SELECT *, min(len(path)) OVER (PARTITION BY s, t) AS shortest FROM walks{k} WHERE s < t) WHERE len(path) = shortest),
shared{k} AS (SELECT *, count(*) OVER (PARTITION BY s, t) AS paths FROM best{k}),
inner{k} AS (SELECT unnest(path[2:len(path) - 1]) AS node_id, 1.0 / paths AS part FROM shared{k}),
bet{k} AS (SELECT n.cluster_id, n.node_id, coalesce(sum(part), 0) AS betweenness FROM (SELECT DISTINCT cluster_id, a AS node_id FROM ways{k}) n LEFT JOIN inner{k} i USING (node_id) GROUP BY ALL)"""


def refined(k: int, threshold: int) -> str:
    """edges{k+1} of edges{k}: nodes with an outlier score below the threshold, clusters named by their smallest node; raw{k+1} has the first cluster of each node."""
    n = k + 1
    return f"""{betweenness_of(k)},
middle{k} AS (SELECT *, median(betweenness) OVER (PARTITION BY cluster_id) AS m FROM bet{k}),
away{k} AS (SELECT *, abs(betweenness - m) AS d FROM middle{k}),
kept{k} AS (SELECT cluster_id, node_id FROM (SELECT *, median(d) OVER (PARTITION BY cluster_id) AS mad FROM away{k}) WHERE CASE WHEN mad > 0 THEN d / mad ELSE 0 END < {threshold}),
left{k} AS (SELECT e.cluster_id, e.src, e.dst FROM edges{k} e JOIN kept{k} x ON x.node_id = e.src JOIN kept{k} y ON y.node_id = e.dst),
both{k} AS (SELECT src AS node_id, dst AS other FROM left{k} UNION ALL SELECT dst, src FROM left{k}),
reach{k}(node_id, other) AS (SELECT node_id, node_id FROM both{k} UNION SELECT r.node_id, b.other FROM reach{k} r JOIN both{k} b ON b.node_id = r.other),
label{k} AS (SELECT node_id, min(other) AS cluster_id FROM reach{k} GROUP BY ALL),
edges{n} AS (SELECT l.cluster_id, e.src, e.dst FROM left{k} e JOIN label{k} l ON l.node_id = e.src)"""


USER_CLUSTERS = USER_EDGES + ",\n" + parts("both_ways") + ",\n" + reach() + ",\n" + parts("members", "inside") + ",\nedges0 AS (SELECT cluster_id, src, dst FROM inside)"


def refinement(*thresholds: int) -> str:
    rounds = ",\n".join(refined(k, t) for k, t in enumerate(thresholds))
    last = f"edges{len(thresholds)}"
    return with_(
        f"{USER_CLUSTERS},\n{rounds}",
        f"SELECT n.cluster_id, n.node_id, m.cluster_id AS raw_cluster_id FROM (SELECT cluster_id, src AS node_id FROM {last} UNION SELECT cluster_id, dst FROM {last}) n JOIN members m ON m.node_id = n.node_id",
    )


#: Fragment ions of the parts' peptides by cumulated sums of residue masses from both ends.
IONS = f"""spelled AS (SELECT p_partkey AS node_id, substr(translate(upper(p_name), 'BJXZ #0123456789', 'GGGG'), 1, 16) AS peptide, p_size FROM part),
residues(letter, mass) AS (VALUES {', '.join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in ions.RESIDUES.items())}),
single AS (SELECT node_id, p_size, i, length(peptide) AS n, CASE WHEN p_size % 3 = 0 AND i = 1 + p_size % greatest(length(peptide), 1) THEN 160.0307 ELSE r.mass END AS mass
 FROM (SELECT *, unnest(range(1, length(peptide) + 1)) AS i FROM spelled) LEFT JOIN residues r ON r.letter = substr(peptide, i, 1)),
cumulated AS (SELECT node_id, p_size, 'p' AS side, i AS number, n, sum(mass) OVER (PARTITION BY node_id ORDER BY i) AS s, count(*) FILTER (mass IS NULL) OVER (PARTITION BY node_id ORDER BY i) AS unknown FROM single
 UNION ALL SELECT node_id, p_size, 's', n + 1 - i, n, sum(mass) OVER (PARTITION BY node_id ORDER BY i DESC), count(*) FILTER (mass IS NULL) OVER (PARTITION BY node_id ORDER BY i DESC) FROM single),
kinds(series, side, plus) AS (VALUES {', '.join(f"('{k}', '{end[0]}', CAST({plus!r} AS DOUBLE))" for k, (end, plus) in ions.SERIES.items())}),
ions AS (SELECT node_id, series, z, number, series || CAST(number AS VARCHAR) || repeat('+', z) AS ion,
 (s + plus + CASE WHEN side = 'p' AND p_size % 5 = 0 THEN 43.0184 - {ions.HYDROGEN!r} WHEN side = 's' AND p_size % 7 = 0 THEN 18.0 - {ions.WATER - ions.HYDROGEN!r} ELSE 0 END + z * {ions.PROTON!r}) / z AS mz
 FROM (SELECT *, unnest(range(1, 2 + p_size % 3)) AS z FROM cumulated WHERE number < n AND unknown = 0) JOIN kinds USING (side))"""

ORACLE = {
    "betweenness_by_levels": with_(f"{USER_CLUSTERS},\n{betweenness_of(0)}", "SELECT cluster_id, node_id, round(betweenness, 6) AS betweenness FROM bet0"),
    "betweenness": with_(f"{USER_CLUSTERS},\n{betweenness_of(0)}", "SELECT cluster_id, node_id, round(betweenness, 6) AS betweenness FROM bet0"),
    "refine_round": refinement(3),
    "refine_multi": refinement(5, 3),
    "ms2_scan_filter": f"""WITH scans AS (SELECT l_partkey AS node_id, count(*) AS peaks_count FROM lineitem GROUP BY ALL)
SELECT s.node_id, s.peaks_count, CAST(p.p_retailprice AS FLOAT) AS mass, CAST(p.p_retailprice * (1 + p.p_size % 3) AS FLOAT) AS true_mass
FROM scans s JOIN part p ON p.p_partkey = s.node_id WHERE s.node_id % 7 <> 0 AND s.peaks_count >= {LEAST}""",
    "scan_counts": f"""WITH scans AS (SELECT l_partkey AS node_id, count(*) AS peaks_count FROM lineitem GROUP BY ALL)
SELECT count(*) FILTER (node_id % 7 <> 0) AS total_ms2, count(*) FILTER (node_id % 7 <> 0 AND peaks_count >= {LEAST}) AS valid_ms2 FROM scans""",
    "index_by_mass": f"WITH {parts('part_index')} SELECT native_id, mass, row_number() OVER (ORDER BY mass, native_id) - 1 AS position FROM part_index",
    "index_slice": f"WITH {parts('part_index')} SELECT * FROM (SELECT native_id, mass, row_number() OVER (ORDER BY mass, native_id) - 1 AS position FROM part_index) WHERE position >= 50 AND position < 150",
    "index_point": f"WITH {parts('part_index')} SELECT * FROM (SELECT native_id, mass, row_number() OVER (ORDER BY mass, native_id) - 1 AS position FROM part_index) WHERE position = 42",
    "input_limit": """WITH scans AS (SELECT l_suppkey AS file_id, l_orderkey, l_linenumber FROM lineitem), files AS (SELECT file_id, count(*) AS n FROM scans GROUP BY ALL),
taken AS (SELECT file_id FROM (SELECT file_id, sum(n) OVER (ORDER BY file_id) - n AS before FROM files) WHERE before < 3000) SELECT file_id, count(*) AS scans FROM scans JOIN taken USING (file_id) GROUP BY ALL""",
    "peaks_clip": f"WITH {parts('user_peaks')} SELECT node_id, count(*) AS n, round(sum(intensity), 3) AS intensity, min(mz) AS lowest, max(mz) AS highest FROM user_peaks WHERE mz BETWEEN 5 AND 300 GROUP BY ALL",
    "precursor_removal": f"""WITH {parts('user_peaks', 'user_index')} SELECT node_id, count(*) AS n, round(sum(intensity), 3) AS intensity FROM user_peaks JOIN user_index USING (node_id)
WHERE mz < mass + CAST(-395 AS FLOAT) OR mz > mass + CAST(-370 AS FLOAT) GROUP BY ALL""",
    "precursor_removal_true_mass": f"""WITH {parts('user_peaks', 'user_index')} SELECT node_id, count(*) AS n, round(sum(intensity), 3) AS intensity FROM user_peaks JOIN user_index USING (node_id)
WHERE mz < CAST(mass / CAST(charge AS FLOAT) AS FLOAT) + CAST(-95 AS FLOAT) OR mz > CAST(mass / CAST(charge AS FLOAT) AS FLOAT) + CAST(-20 AS FLOAT) GROUP BY ALL""",
    "sorted_peaks": f"WITH {parts('user_peaks')}, marked AS (SELECT node_id, mz, lag(mz) OVER (PARTITION BY node_id ORDER BY mz) AS before FROM user_peaks) SELECT node_id, count(*) FILTER (before = mz) = 0 AS ascending FROM marked GROUP BY ALL",
    "mz_binning": f"WITH {parts('user_peaks')}, {ranked('user_peaks')} SELECT node_id, bin, round(intensity, 3) AS intensity FROM binned",
    "mz_binning_half": f"WITH {parts('part_peaks')}, {ranked('part_peaks', bins=2)} SELECT node_id, bin, round(intensity, 3) AS intensity FROM binned",
    "rank_transform": f"WITH {RANKED_PARTS} SELECT node_id, bin, rank, n FROM ranked",
    "rank_transform_ties": f"WITH {parts('user_peaks')}, {ranked('user_peaks', 50)} SELECT node_id, bin, rank, n FROM ranked",
    "rank_transform_vectors": f"""WITH vector_peaks AS (SELECT vec_id AS node_id, CAST(100 + 10 * (u.i - 1) AS FLOAT) AS mz, CAST(abs(embedding[u.i]) AS DOUBLE) AS intensity FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u), {ranked('vector_peaks')} SELECT node_id, bin, rank, n FROM ranked""",
    "ranked_norm": f"WITH {RANKED_PARTS} SELECT node_id, any_value(n) AS n, CAST(sum(CAST(rank AS BIGINT) * rank) AS BIGINT) AS norm2 FROM ranked GROUP BY ALL",
    "band_pairs": f"WITH {parts('part_index')} SELECT a.node_id AS src, b.node_id AS dst FROM part_index a JOIN part_index b ON a.node_id < b.node_id AND abs(a.mass - b.mass) <= CAST({TOL} AS FLOAT)",
    "logistic_edges": f"WITH {RANKED_PARTS}, {scored('part_index')}, l AS (SELECT src, dst, 1.0 / (1.0 + exp(-(-0.5275 * CAST(abs(m_a - m_b) AS DOUBLE) + 4.5572 * dp + -1.8332))) AS dp FROM scored) SELECT src, dst, round(dp, 6) AS dp FROM l WHERE dp > 0.6",
    "verificative_pair": f"""WITH {RANKED_PARTS}, sizes AS (SELECT DISTINCT node_id, n FROM ranked), pairs AS (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part),
products AS (SELECT p.src, p.dst, CAST(sum(CAST(a.rank AS BIGINT) * b.rank) AS BIGINT) AS product FROM pairs p JOIN ranked a ON a.node_id = p.src JOIN ranked b ON b.node_id = p.dst AND a.bin = b.bin GROUP BY ALL)
SELECT p.src, p.dst, round(coalesce(product, 0) / sqrt(CAST((CAST(a.n AS BIGINT)*(a.n+1)*(2*a.n+1)//6) * (CAST(b.n AS BIGINT)*(b.n+1)*(2*b.n+1)//6) AS DOUBLE)), 6) AS dp
FROM pairs p LEFT JOIN products USING (src, dst) LEFT JOIN sizes a ON a.node_id = p.src LEFT JOIN sizes b ON b.node_id = p.dst""",
    "edge_audit": f"""WITH {EDGES}, sizes AS (SELECT node_id, sqrt(CAST(sum(CAST(rank AS BIGINT) * rank) AS DOUBLE)) AS length FROM ranked GROUP BY ALL),
again AS (SELECT e.src, e.dst, sum(a.rank * b.rank / x.length / y.length) AS dp FROM edges e JOIN ranked a ON a.node_id = e.src JOIN ranked b ON b.node_id = e.dst AND b.bin = a.bin JOIN sizes x ON x.node_id = e.src JOIN sizes y ON y.node_id = e.dst GROUP BY ALL)
SELECT count(*) AS edges, count(*) FILTER (abs(e.dp - again.dp) > 1e-6 * abs(e.dp)) AS wrong_dp, count(*) FILTER (abs(i.mass - j.mass) > CAST({TOL} AS FLOAT)) AS too_far, count(*) FILTER (e.dp <= {T}) AS too_low
FROM edges e JOIN again USING (src, dst) JOIN part_index i ON i.node_id = e.src JOIN part_index j ON j.node_id = e.dst""",
    "ion_match": f"""WITH {parts('part_peaks')}, a AS (SELECT node_id, CAST(trunc(mz) AS INTEGER) AS ion, intensity FROM part_peaks) SELECT a.node_id, a.ion, count(*) AS matches FROM a
JOIN (SELECT p_partkey AS node_id, p_size AS ion FROM part UNION ALL SELECT p_partkey, p_size % 10 + 1 FROM part) e USING (node_id, ion) GROUP BY ALL""",
    "fragment_ions": f"WITH {IONS} SELECT node_id, series, CAST(z AS INTEGER) AS z, count(*) AS n, round(sum(mz), 3) AS mz, arg_max(ion, number) AS last FROM ions GROUP BY ALL",
    "annotated_peaks": f"""WITH {IONS}, vector_peaks AS (SELECT vec_id AS node_id, 100 + 10 * (i - 1) AS mz, abs(CAST(embedding[i] AS DOUBLE)) AS intensity FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
seen AS (SELECT node_id, CAST(floor(mz) AS INTEGER) AS bin, sum(intensity) AS intensity FROM vector_peaks GROUP BY ALL),
named AS (SELECT node_id, CAST(floor(mz) AS INTEGER) AS bin, string_agg(DISTINCT ion, ' ' ORDER BY ion) AS ions FROM ions GROUP BY ALL)
SELECT node_id, bin, round(CAST(intensity AS DOUBLE), 6) AS intensity, ions FROM seen JOIN named USING (node_id, bin)""",
    "vertex_degree": f"WITH {EDGES}, {parts('both_ways')} SELECT node_id, count(*) AS degree FROM both_ways GROUP BY ALL",
    "connected_components": with_(CLUSTERS, "SELECT cluster_id, node_id FROM members"),
    "progressive_labels": with_(CLUSTERS, "SELECT cluster_id, node_id FROM members"),
    "component_histogram": with_(CLUSTERS, "SELECT num_nodes, count(*) AS clusters FROM (SELECT cluster_id, count(*) AS num_nodes FROM members GROUP BY ALL) GROUP BY ALL"),
    "cluster_summary": with_(
        CLUSTERS,
        """SELECT * FROM (SELECT cluster_id, count(*) AS num_nodes, round(avg(CAST(mass AS DOUBLE)), 6) AS mass_avg FROM members JOIN part_index USING (node_id) GROUP BY ALL) JOIN (SELECT cluster_id, count(*) AS num_edges FROM inside GROUP BY ALL) USING (cluster_id)""",
    ),
    "dbscan_point_types": with_(f"{EDGES}, {parts('both_ways')}, {POINTS}", "SELECT node_id, degree, point_type FROM types"),
    "dbscan_clusters": with_(
        f"{EDGES}, {parts('both_ways')}, {POINTS}, {reach('core_ways')}, {DBSCAN}",
        "SELECT cluster_id, node_id, point_type FROM assigned WHERE cluster_id IN (SELECT cluster_id FROM assigned GROUP BY ALL HAVING count(*) > 1)",
    ),
    "dbscan_sql": with_(
        f"{EDGES}, {parts('both_ways')}, {POINTS}, {reach('core_ways')}, {DBSCAN}",
        "SELECT cluster_id, node_id, point_type FROM assigned WHERE cluster_id IN (SELECT cluster_id FROM assigned GROUP BY ALL HAVING count(*) > 1)",
    ),
    "iden_filter": f"WITH {parts('idens')} SELECT ms_file, native_id, peptide, charge, iden_file_id FROM idens WHERE probability >= 0.9 AND NOT is_decoy",
    "iden_dedup": f"WITH {parts('idens')} SELECT ms_file, native_id, peptide, iden_file_id FROM (SELECT *, row_number() OVER (PARTITION BY ms_file, native_id ORDER BY iden_file_id, position DESC) AS rn FROM idens) WHERE rn = 1",
    "iden_lookup_join": f"WITH {parts('part_index', 'idens', 'usable')} SELECT i.node_id, u.peptide, u.charge AS iden_charge FROM part_index i LEFT JOIN usable u ON u.ms_file = i.file_stem AND u.native_id = i.native_id",
    "unidentified_nodes": f"WITH {parts('part_index', 'idens', 'usable')} SELECT i.node_id FROM part_index i WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.ms_file = i.file_stem AND u.native_id = i.native_id)",
    "peptide_string": f"WITH {PEPTIDES} {peptide('CAST(CAST({} AS DOUBLE) AS VARCHAR)')}",
    "peptide_string_int": f"WITH {PEPTIDES} {peptide('CAST(CAST(trunc({}) AS BIGINT) AS VARCHAR)')}",
    "display_string": f"""WITH {PEPTIDES} SELECT native_id, CASE WHEN is_decoy THEN 'DECOY_' ELSE '' END || coalesce(prev_aa, '') || '.' || text || '.' || coalesce(next_aa, '') || '/' || CAST(charge AS VARCHAR) || ' (' || CAST(probability AS VARCHAR) || ')' AS text
FROM peps JOIN ({peptide('CAST(CAST({} AS DOUBLE) AS VARCHAR)')}) USING (native_id)""",
    "cluster_enrichment": with_(
        f"{NAMED}, {ENRICHED}",
        "SELECT cluster_id, num_nodes, CAST(coalesce(num_idens, 0) AS INTEGER) AS num_idens, idens, major_iden, round(named_nodes / num_nodes, 6) AS iden_ratio, round(mass_avg, 6) AS mass_avg FROM totals LEFT JOIN lists USING (cluster_id)",
    ),
    "major_identification": with_(f"{NAMED}, {ENRICHED}", "SELECT cluster_id, major_iden FROM lists"),
    "iden_histogram": with_(f"{NAMED}, {ENRICHED}", "SELECT cluster_id, iden, n FROM counts"),
    "clusters_with_iden": with_(f"{NAMED}, {ENRICHED}", "SELECT iden, count(*) AS clusters, min(cluster_id) AS first_cluster FROM counts GROUP BY ALL"),
    "enrichment_pending": with_(f"{NAMED}, {ENRICHED}", "SELECT cluster_id FROM totals WHERE cluster_id NOT IN (SELECT cluster_id FROM lists)"),
    "cluster_entropy": with_(NAMED, ", " + entropy("cluster_id")).replace("\n, ", ",\n"),
    "cluster_entropy_sql": with_(NAMED, ", " + entropy("cluster_id")).replace("\n, ", ",\n"),
    "peptide_entropy": with_(NAMED, ", " + entropy("iden")).replace("\n, ", ",\n"),
    "cluster_get": with_(CLUSTERS, "SELECT cluster_id, count(*) AS num_nodes FROM members WHERE cluster_id = (SELECT min(cluster_id) FROM members) GROUP BY ALL"),
    "cluster_exists": with_(CLUSTERS, "SELECT n.node_id, EXISTS (SELECT 1 FROM members m WHERE m.cluster_id = n.node_id) AS is_cluster FROM part_index n"),
    "largest_cluster": with_(
        CLUSTERS, "SELECT * FROM (SELECT cluster_id, count(*) AS num_nodes FROM members GROUP BY ALL) JOIN (SELECT cluster_id, count(*) AS num_edges FROM inside GROUP BY ALL) USING (cluster_id) ORDER BY num_nodes DESC, cluster_id LIMIT 1"
    ),
    "weakest_edge": with_(CLUSTERS, "SELECT cluster_id, src, dst, round(dp, 6) AS dp FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dp, src, dst) AS rn FROM inside) WHERE rn = 1"),
    "decode_roundtrip": f"WITH {parts('part_peaks')} SELECT node_id, count(*) AS n, sum(CAST(mz AS DOUBLE)) AS mz, round(sum(CAST(CAST(intensity AS FLOAT) AS DOUBLE)), 1) AS intensity FROM part_peaks GROUP BY ALL",
    "cluster_texts": with_(
        f"{NAMED}, {ENRICHED}",
        """SELECT cluster_id, nodes + edges + 5 AS lines, concat_ws(chr(9), CAST(cluster_id AS VARCHAR), CAST(nodes AS VARCHAR), CAST(edges AS VARCHAR), CAST(coalesce(num_idens, 0) AS VARCHAR), coalesce(major_iden, 'None')) AS own, last_edge, CAST(1 AS BIGINT) AS empty
FROM (SELECT cluster_id, count(*) AS nodes FROM members GROUP BY ALL)
JOIN (SELECT cluster_id, count(*) AS edges, arg_max(concat_ws(chr(9), CAST(src AS VARCHAR), CAST(dst AS VARCHAR), printf('%.8f', dp)), (src, dst)) AS last_edge FROM inside GROUP BY ALL) USING (cluster_id) LEFT JOIN lists USING (cluster_id)""",
    ),
    "export_lines": with_(
        f"{NAMED}",
        """SELECT cluster_id, 3 AS section, concat_ws(chr(9), CAST(i.node_id AS VARCHAR), i.file_stem, CAST(i.native_id AS VARCHAR), coalesce(n.iden, 'None'), coalesce(CAST(n.probability AS VARCHAR), 'None')) AS line FROM named n JOIN part_index i USING (node_id)
UNION ALL SELECT cluster_id, 5, concat_ws(chr(9), CAST(src AS VARCHAR), CAST(dst AS VARCHAR), printf('%.8f', dp)) FROM inside""",
    ),
    "verificative_raw": f"""WITH {parts('user_peaks', 'user_index')}, cut AS (SELECT node_id, mz, intensity FROM user_peaks JOIN user_index USING (node_id) WHERE mz BETWEEN 5 AND 300 AND (mz < mass + CAST(-395 AS FLOAT) OR mz > mass + CAST(-370 AS FLOAT))),
{ranked('cut', 50)}, sizes AS (SELECT DISTINCT node_id, n FROM ranked), pairs AS (SELECT node_id AS src, node_id + 1 AS dst FROM user_index),
products AS (SELECT p.src, p.dst, CAST(sum(CAST(a.rank AS BIGINT) * b.rank) AS BIGINT) AS product FROM pairs p JOIN ranked a ON a.node_id = p.src JOIN ranked b ON b.node_id = p.dst AND a.bin = b.bin GROUP BY ALL)
SELECT p.src, p.dst, round(coalesce(product, 0) / sqrt(CAST((CAST(a.n AS BIGINT)*(a.n+1)*(2*a.n+1)//6) * (CAST(b.n AS BIGINT)*(b.n+1)*(2*b.n+1)//6) AS DOUBLE)), 6) AS dp
FROM pairs p LEFT JOIN products USING (src, dst) LEFT JOIN sizes a ON a.node_id = p.src LEFT JOIN sizes b ON b.node_id = p.dst""",
}
_SCANS = f"""WITH {parts('part_peaks', 'part_index')}, summed AS (SELECT node_id, mz, CAST(sum(intensity) AS FLOAT) AS intensity FROM part_peaks GROUP BY ALL)
SELECT node_id AS native_id, 2 AS ms_level, CAST(count(*) AS INTEGER) AS peaks_count, any_value(mass) AS precursor_mz, any_value(charge) AS charge, sum(CAST(mz AS DOUBLE)) AS mz, round(sum(CAST(intensity AS DOUBLE)), 0) AS intensity, true AS whole
FROM summed JOIN part_index USING (node_id) GROUP BY node_id HAVING count(*) >= {LEAST}"""
ORACLE |= {
    "progressive_edges": f"WITH {EDGES} SELECT src, dst, round(dp, 6) AS dp FROM edges JOIN part p ON p.p_partkey = src JOIN part q ON q.p_partkey = dst WHERE p.p_size > 25 OR q.p_size > 25",
    "mzxml_scans": _SCANS,
    "mzml_scans": _SCANS,
    "indexed_mzxml_scans": _SCANS,
    "indexed_mzml_scans": _SCANS,
    "raw_block_texts": "SELECT p_partkey AS native_id, true AS whole, p_partkey AS said, CAST(1 + p_size % 3 AS INTEGER) AS charge FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)",
    "pepxml_identifications": f"WITH {parts('idens')}, usable AS (SELECT * FROM idens), {parts('modified')} SELECT ms_file, native_id, regexp_replace(iden, '/[0-9]+$', '') AS text, charge, probability, 'pp' AS source, is_decoy FROM modified",
    "identification_store": f"WITH {parts('idens')} SELECT ms_file, native_id, peptide, charge, probability, iden_file_id, position FROM (SELECT *, row_number() OVER (PARTITION BY ms_file, native_id ORDER BY iden_file_id, position DESC) AS rn FROM idens WHERE probability >= 0.3 AND NOT is_decoy) WHERE rn = 1",
    "enrichment_update": with_(
        f"""{CLUSTERS}, {parts('idens', 'usable', 'modified')}, every AS ({PARTS['named']}), sure AS (SELECT DISTINCT cluster_id FROM every WHERE iden IS NOT NULL AND probability >= 0.9),
named AS (SELECT cluster_id, node_id, mass, CASE WHEN probability >= 0.9 OR cluster_id NOT IN (SELECT cluster_id FROM sure) THEN iden END AS iden FROM every), {ENRICHED}""",
        "SELECT cluster_id, num_nodes, CAST(coalesce(num_idens, 0) AS INTEGER) AS num_idens, idens, major_iden, round(named_nodes / num_nodes, 6) AS iden_ratio, round(mass_avg, 6) AS mass_avg FROM totals LEFT JOIN lists USING (cluster_id)",
    ),
    "run_stages": ORACLE["cluster_enrichment"],
}
ORACLE["enrichment_in_place"] = ORACLE["enrichment_update"]
ORACLE["identification_counts"] = f"""WITH {parts('idens')}, sure AS (SELECT * FROM idens WHERE probability >= 0.3 AND NOT is_decoy)
SELECT (SELECT count(*) FROM idens) AS total, (SELECT count(*) FROM idens WHERE probability < 0.3) AS unsure, (SELECT count(*) FROM idens WHERE probability >= 0.3 AND is_decoy) AS decoys, (SELECT count(*) FROM sure) AS taken,
 (SELECT count(*) FROM sure) - (SELECT count(*) FROM (SELECT DISTINCT ms_file, native_id FROM sure)) AS duplicates, (SELECT count(*) FROM (SELECT DISTINCT ms_file, native_id FROM sure)) AS kept"""
for _name in ("dot_product_edges", "dot_product_edges_prefix", "dot_product_edges_block"):
    ORACLE[_name] = f"WITH {EDGES} SELECT src, dst, round(dp, 6) AS dp FROM edges"
#: An edge depends on its two ends alone, so what a file loses are the edges of the scans that it no longer holds.
ORACLE["run_changed_input"] = f"WITH {EDGES} SELECT src, dst, round(dp, 6) AS dp, 1 AS fresh FROM edges WHERE src % 10 <> 7 AND dst % 10 <> 7"
ORACLE["user_edges"] = f"WITH {USER_EDGES} SELECT src, dst, round(dp, 6) AS dp FROM edges"
