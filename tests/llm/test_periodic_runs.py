"""Runs against a search of all periods, the grammar against plain comparison."""

import hashlib
import zlib

import numpy as np
import pytest

from specgraph.llm import periodic_runs as P


def plain(words):
    """(start, length, period) of all runs, place by place for each period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        j = 0
        while j + q < n:
            s = j
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - s + q >= max(6, 4 * q):
                out.setdefault((s, j - s + q), q)
            j += j == s
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def described(key, text, plant):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(key).encode())
    if plant and key is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        words = words[:a] + [words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(a, n)]
    runs = plain(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (
        key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def random_words(rng, most=140):
    n, letters = int(rng.integers(0, most)), int(rng.integers(1, 6))
    t = rng.integers(0, letters, n)
    for _ in range(rng.integers(0, 4)):
        if n > 10:
            a, p = int(rng.integers(0, n)), int(rng.integers(1, 25))
            b = int(rng.integers(a, n)) + 1
            t[a:b] = t[a + np.arange(b - a) % min(p, b - a)]
    return t


def test_runs_of_many_texts_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    for places in (1 << 20, 50):
        monkeypatch.setattr(P, "PLACES", places)
        for _ in range(120):
            texts = [random_words(rng) for _ in range(rng.integers(1, 9))]
            for text, got in zip(texts, P.runs_of(texts)):
                assert [tuple(r) for r in got.tolist()] == plain(text.tolist())


@pytest.mark.parametrize("words", [[0] * 6, [0] * 5, [0, 1] * 4, [0, 1] * 3 + [0], [0] * 100, ([0, 0, 1] * 20 + [2]) * 6, [0, 1, 0, 0, 1] * 8, []])
def test_nested_and_smallest_runs(words):
    assert [tuple(r) for r in P.runs_of([np.array(words, np.int64)])[0].tolist()] == plain(words)


def test_agreement_by_the_grammar():
    rng = np.random.default_rng(4)
    for _ in range(60):
        w = random_words(rng, 300)
        n = len(w)
        if n < 2:
            continue
        levels = P.recompress(w)
        p, q = rng.integers(0, n + 1, (2, 80))
        p, q = p[p != q], q[p != q]
        ahead = [next((c for c in range(n) if max(a, b) + c >= n or w[a + c] != w[b + c]), n) for a, b in zip(p.tolist(), q.tolist())]
        back = [next((c for c in range(n) if min(a, b) - c <= 0 or w[a - c - 1] != w[b - c - 1]), n) for a, b in zip(p.tolist(), q.tolist())]
        assert P.agree(levels, n, p, q).tolist() == ahead
        assert P.agree([x.mirrored(n) for x in levels], n, n - p, n - q).tolist() == back


def test_few_levels_for_long_texts():
    w = np.arange(200_000) % 50_000
    levels = P.recompress(w)
    assert len(levels) < 120 and sum(len(x.symbols) for x in levels) < 8 * len(w)
    assert P.runs_of([w])[0].tolist() == [[0, 200_000, 50_000]]


def documents(rng, n):
    out = []
    for i in range(n):
        t = random_words(rng)
        sep = [" ", "\n", "\t ", "\x0b", "\r\n"]
        out.append((i, "".join(f"w{x}é" + sep[int(rng.integers(5))] for x in t)))
    return out


@pytest.mark.parametrize("plant", [True, False])
def test_documents(spark, monkeypatch, plant):
    monkeypatch.setattr(P, "CHUNK", 40)
    monkeypatch.setattr(P, "JOINED", 7)
    rows = documents(np.random.default_rng(5), 150) + [(1000, None), (1001, ""), (1002, " \n\t"), (None, "a " * 9), (None, None), (-7, "x y " * 5), (3, "a b"), (3, "a b"), (2000, "ab " * 30_000), (2001, "z" * 100_000)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_runs string, start int").repartition(3)
    got = sorted((tuple(r) for r in P.periodic_runs(d, plant=plant).collect()), key=str)
    assert got == sorted((described(k, t, plant) for k, t in rows), key=str)


def test_collapse_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "start  " + "again and " * 5 + "end", 5), (2, "left  as\nit is", 6), (None, None, 7)], "doc_id long, text string, period int")
    assert {r.period: r.text for r in P.collapse(d).collect()} == {5: "start again and end", 6: "left  as\nit is", 7: None}
    assert P.collapse(d).columns == d.columns
    assert P.periodic_runs(d.limit(0)).collect() == [] and P.collapse(d.limit(0)).collect() == []
