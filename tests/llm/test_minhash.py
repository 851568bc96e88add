"""Near duplicates against all pairs of plain Python sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specgraph.llm import minhash as M


def shingles(text, words):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, words):
    """component of each id, by union-find over all pairs"""
    sets = [(k, shingles(t, words)) for k, t in rows if k is not None]
    up = {k: k for k, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            n = len(s & t)
            if n and 100 * n >= 80 * (len(s) + len(t) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in up}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\n\x0b\x1c", max_size=30), max_size=6), st.integers(1, 5))
def test_shingles(texts, words):
    got = M.shingle_sets(pa.array([*texts, None], pa.string()), words)
    want = [shingles(t, words) for t in [*texts, None]]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(want)):
        for j in range(len(want)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000, np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    sig = M.signatures([a, b])
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.15


def test_least_matches_lose_few():
    least = M.least_matches(80)
    assert least == sorted(least) and 0 < least[0] < M.BATCH and 64 < least[-1] < 0.8 * M.HASHES


def corpus(seed, groups, size):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    return rows


ODD = ["", None, " ", "one", "ONE", "one two", "one two three four", "a b c d e", "word " * 30_000, "\n\tone"]


@pytest.mark.parametrize("words,small,rows_of_block", [(4, 16, 256), (5, 1, 5)])
def test_components(spark, monkeypatch, words, small, rows_of_block):
    monkeypatch.setattr(M, "SMALL", small)
    monkeypatch.setattr(M, "BLOCK_ROWS", rows_of_block)
    rows = corpus(words, 25, 12)
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(5000, rows[0][1]), (5001, rows[0][1]), (5001, rows[0][1]), (None, rows[0][1]), (None, None)]
    d = spark.createDataFrame([(k, t, "x", 7) for k, t in rows], "doc_id long, text string, band string, size int").repartition(3)
    got = M.near_duplicates(d, words=words).collect()
    want = brute(rows, words)
    assert len(got) == len(rows)
    sizes = {k: len(shingles(t, words)) for k, t in rows}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.doc_id, r.n_shingles, r.component_id, r.kept) == (r.doc_id, sizes[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_block_links_are_exact():
    rows = corpus(9, 6, 20)
    sets = [s for s in M.shingle_sets(pa.array([t for _, t in rows]), 4)]
    sig = (M.signatures(sets) & 0xFF).astype(np.uint8)
    block = [{"id": k, "own": k, "n": len(s), "signature": g.tobytes(), "text": t} for (k, t), s, g in zip(rows, sets, sig)]
    got = M.block_links(block, block, 4, 80, M.least_matches(80))
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            n = len(np.intersect1d(s, t))
            assert got[i, j] == (i != j and 100 * n >= 80 * (len(s) + len(t) - n))
    ids = np.array([k for k, _ in rows])
    up = {k: k for k in ids.tolist()}
    for a, b in zip(*M.holding_edges(got, ids, ids)):
        up[int(a)] = int(b)
    want = brute(rows, 4)
    assert all(up[k] == want[k] for k in up)


def test_empty(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_words_of_one_family_differ(spark):
    """Words that every polynomial hash modulo a power of two sends to one value."""

    def word(turned):
        bits = [bin(i).count("1") % 2 ^ turned for i in range(2048)]
        return "".join("ab"[b] for b in bits)

    d = spark.createDataFrame([(1, word(0)), (2, word(1)), (3, word(0))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in M.near_duplicates(d, words=4).collect()} == {1: 1, 2: 2, 3: 1}


def test_recall_just_above_the_threshold(spark):
    """Pairs of a similarity between 0.80 and 0.85, and others just below 0.80: every link found, none invented."""
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = list(words)
        for at in rng.sample(range(10, 290), rng.choice([6, 7, 8, 9, 10])):
            other[at] = f"x{rng.randrange(10**6)}"
        a, b = shingles(" ".join(words), 4), shingles(" ".join(other), 4)
        similar = len(a & b) / len(a | b)
        if 0.75 <= similar <= 0.85:
            rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
            want[2 * i + 1] = 2 * i if 100 * len(a & b) >= 80 * len(a | b) else 2 * i + 1
    assert sum(k != v for k, v in want.items()) > 20 and sum(k == v for k, v in want.items()) > 20
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in M.near_duplicates(d, words=4).collect()}
    assert all(got[k] == v for k, v in want.items())
