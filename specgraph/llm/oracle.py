"""SQL of the queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

#: Components of links(a, b) by reachability, as reached(id, other); every linked id reaches itself.
_REACHED = """ways AS (SELECT a AS id, b AS other FROM links UNION SELECT b, a FROM links UNION SELECT a, a FROM links UNION SELECT b, b FROM links),
reached(id, other) AS (SELECT id, other FROM ways UNION SELECT r.id, w.other FROM reached r JOIN ways w ON w.id = r.other),
components AS (SELECT id, min(other) AS component_id FROM reached GROUP BY ALL)"""

#: Words of lower-cased texts, distinct shingles of four (all words as one where there are fewer), links on whole sets.
NEAR_DUPLICATES = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END AS s
 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
{_REACHED}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN components c ON c.id = d.doc_id"""

def near_vectors(threshold: float) -> str:
    """Links, components and kept vectors at a cosine."""
    return f"""WITH RECURSIVE usable AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= {threshold}),
degrees AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY ALL),
{_REACHED}
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degrees d ON d.id = e.vec_id LEFT JOIN components c ON c.id = e.vec_id"""


def _base_spans(kinds: list[tuple[str, str, str]]) -> str:
    """Spans of (kind, pattern, test of the match m): what stands between matches and the matches themselves add up to positions."""
    found = "\nUNION ALL ".join(
        f"""SELECT doc_id, {k} AS rank, '{kind}' AS kind, m, p, list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda v: length(v))), 0) AS start
 FROM (SELECT doc_id, ms, g, i, ms[i] AS m, '{pattern}' AS p FROM (SELECT doc_id, ms, g, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS g FROM texts) WHERE len(ms) > 0)) WHERE {test}"""
        for k, (kind, pattern, test) in enumerate(kinds)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in kinds)
    columns = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _, _ in kinds)
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({found}),
merged AS (SELECT doc_id, {counts}, string_agg(kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(start + length(m) AS VARCHAR), ',' ORDER BY start, rank) AS joined FROM spans GROUP BY ALL)
SELECT d.doc_id, {columns}, sha256(coalesce(joined, '')) AS base_sha256 FROM documents d LEFT JOIN merged USING (doc_id)"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER)
 ELSE (2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER)) // 10 + (2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER)) % 10 END)) % 10 = 0"""
_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

BASE_SECRETS = _base_spans([("assign", _ASSIGN, "length(regexp_extract(m, p, 2)) >= 6"), ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"), ("hex", "[0-9a-f]+", "length(m) >= 24")])

BASE_PERSONAL_DATA = _base_spans(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
    ]
)

#: All anchors with all rows; positives by place, then the rows of other labels within each positive's window.
HARD_NEGATIVES = """WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.vec_id AS anchor, c.vec_id AS other, a.label = c.label AS own, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.q) = len(c.q)),
positives AS (SELECT * FROM scored WHERE own QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.own AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score QUALIFY rank <= 10"""

LINE_DEDUP = """WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, lines[i] AS line, i, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
 FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split)),
shared AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, s.key IS NOT NULL AS gone FROM lines l LEFT JOIN shared s ON s.key = l.key AND l.doc_id <> s.last)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""

#: crc32 bit by bit over the id's digits; runs from all pairs of equal words of a document as islands of places for each distance.
PERIODIC_RUNS = r"""WITH ids AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
plan AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM ids),
place AS (SELECT doc_id, w, n, planted, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM plan),
words AS (SELECT doc_id, n, i, CASE WHEN planted AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(0, n)) AS i FROM place)),
alike AS (SELECT x.doc_id, x.n, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM alike) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM islands GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS t FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY ALL),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
joined AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY ALL)
SELECT d.doc_id, coalesce(j.n_runs, 0) AS n_runs, l.start, l.length, l.period, 1000 * l.length // l.period AS exponent_milli, sha256(coalesce(j.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN joined j USING (doc_id) LEFT JOIN longest l USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
