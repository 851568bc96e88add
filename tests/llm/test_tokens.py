"""Token output, packing and the chunk encoder against the tokenizers library itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specgraph.llm import packing, token_output
from specgraph.llm.encoders import ChunkEncoder, default_path
from specgraph.storage import new_path

TEXTS = ["", " ", "a", "it's  here", "x \n y", "x\n \ty", "  lead", "trail ", "a\n ", "a\n  b", "naïve été  　 ß", "x" * 5000, "The cat. The cat.\n\nThe 12 345 cats!", "\x1c \x1d", "<|endoftext|> a", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", " <|endoftext|>  "]
DOC = "doc_id long, text string, task string, length int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def chunked():
    e = ChunkEncoder(default_path())
    return lambda texts: [x.tolist() for x in e.encode(pa.array(texts, pa.string()))]


def test_texts_of_special_tokens(library, chunked):
    assert library("a <|endoftext|> b") == [64, 220, 50256, 275]
    assert chunked(["a <|endoftext|> b"]) == [[64, 220, 50256, 275]]


def test_chunks_equal_the_library(library, chunked):
    assert chunked(TEXTS + [None]) == [library(t) for t in TEXTS + [None]]
    assert chunked(TEXTS) == [library(t) for t in TEXTS]  # from the cache


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'st1. \n\t  é,", max_size=30))
def test_any_text_equals_the_library(library, chunked, text):
    assert chunked([text]) == [library(text)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], DOC)


def test_token_table(spark, library):
    rows = list(enumerate(TEXTS * 3)) + [(None, "nokey"), (None, None), (5, "again"), (99, None)]
    path = new_path(spark, "t")
    token_output.write_token_table(docs(spark, rows), path, shard_tokens=500)
    got = [tuple(r) for r in token_output.read_documents(spark, path).collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for k, t in order:
        ids = library(t) + [0]
        want.append((k, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    found = {r.doc_id: r.ids for r in token_output.fetch(spark, path, [3, 99, 12345]).collect()}
    assert found == {3: library(TEXTS[3]) + [0], 99: [0]}
    assert sorted(r.ids for r in token_output.fetch(spark, path, [5]).collect()) == sorted([library(TEXTS[5]) + [0], library("again") + [0]])


def test_keyed_reads_touch_one_document(spark, library):
    rows = [(i, f"word{i} " * 50) for i in range(2000)]
    path = new_path(spark, "t")
    token_output.write_token_table(docs(spark, rows).repartition(3), path)
    folder = token_output.directory(spark, path)
    assert folder.agg({"n_tokens": "sum"}).head()[0] > 200_000
    got = token_output.fetch(spark, path, [777]).collect()
    ids = library(rows[777][1]) + [0]
    assert [(r.doc_id, r.ids) for r in got] == [(777, ids)]
    assert got[0].bytes_read == 4 + 20 + 2 * len(ids) + 24  # displacement, slot, ids, and a look for another row of the key


def test_a_hot_key_takes_many_tasks(spark, library):
    """Half of the rows have one key, a third none; some keys have the value that other formats keep for null."""
    rows = [(7, f"text {i % 90} of the key") for i in range(600)] + [(None, f"none {i}") for i in range(400)] + [(-(1 << 63), "lowest"), (1 << 62, "x")] + [(7, "same")] * 200
    path = new_path(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_output.write_token_table(docs(spark, rows).repartition(5), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = token_output.directory(spark, path).collect()
    assert len({s.part for s in shards if s.low is not None and s.low <= 7 <= s.high}) >= 2 and len({s.part for s in shards if s.nulls}) >= 2
    got = sorted(map(tuple, token_output.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert sorted([(k, n, c) for k, _, n, c in got], key=str) == sorted([(k, len(i), crc(i)) for k, t in rows for i in [library(t) + [0]]], key=str)
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    assert [r[0] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert token_output.fetch(spark, path, [7]).count() == 800 and token_output.fetch(spark, path, [-(1 << 63)]).count() == 1


def test_empty_tables(spark):
    path = new_path(spark, "t")
    token_output.write_token_table(docs(spark, []), path)
    assert token_output.read_documents(spark, path).count() == 0
    assert packing.pack(docs(spark, [])).count() == 0


def test_hash_is_minimal_and_perfect():
    keys = np.r_[np.arange(3000) * 7 - 50, [5, 5, 5]]
    h = token_output._hashed(keys, token_output.occurrences(keys))
    seeds, slot = token_output.build_hash(h)
    assert sorted(slot) == list(range(len(keys)))


def test_stores(spark, tmp_path):
    path = f"file://{tmp_path}/with a space"
    token_output.write_token_table(docs(spark, [(1, "a"), (2, "b c")]), path)
    assert token_output.read_documents(spark, path).count() == 2
    with pytest.raises(Exception, match="(?i)uri|scheme"):
        token_output.write_token_table(docs(spark, [(1, "a")]), "nowhere://x/y")


def test_foreign_keys_are_told(tmp_path):
    keys = np.arange(3000, dtype="<i8") * 7
    seeds, slots = token_output.build_index(keys, np.zeros(3000, bool), np.ones(3000, np.int64))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.mph").write_bytes(seeds + slots)
    shard = token_output.Shard(str(tmp_path), "a", 3000, 2, len(seeds) // 4)
    assert [shard.find(int(k)) for k in keys[:50]] == [(i, 1) for i in range(50)]
    assert all(shard.find(10**6 + k) is None for k in range(500)) and shard.find(None) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_plans_use_every_piece_once(lengths):
    counts = {x: lengths.count(x) for x in lengths}
    plan = packing.plan_packing(counts, 24)
    used: dict[int, int] = {}
    for content, n in plan:
        assert n > 0 and sum(content) <= 24
        for x in content:
            used[x] = used.get(x, 0) + n
    assert used == counts
    bins = sum(n for _, n in plan)
    assert bins <= 1.5 * -(-sum(lengths) // 24) + 1


def test_packing(spark, library):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(0, 3000, 120))] + [(7, None), (None, "a b"), (8, "")]
    got = packing.pack(docs(spark, rows).repartition(5)).collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    want = {}
    for k, t in rows:
        want.setdefault(k, []).append(library(t) + [0])
    for k, many in want.items():
        own = sorted(by_doc[k], key=lambda r: (r.start, r.length))
        assert sum(r.length for r in own) == sum(map(len, many))
        if len(many) == 1:
            ids = many[0]
            assert [r.piece for r in own] == list(range(len(own)))
            assert [r.ids_crc32 for r in own] == [crc(ids[r.start : r.start + r.length]) for r in own]
            assert all(r.length == 2048 for r in own[1:])
    at: dict = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(at) <= -(-sum(r.length for r in got) // 2048) + 2


def test_packing_without_a_broadcast_is_the_same(spark, monkeypatch):
    rows = [(i, "word " * (37 * i % 1500)) for i in range(90)]
    whole = sorted(map(tuple, packing.pack(docs(spark, rows).repartition(3)).collect()))
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    plan = packing.pack(docs(spark, rows).repartition(3))
    assert "SortMergeJoin" in plan._jdf.queryExecution().toString()
    assert len(whole) == plan.count() and {r[0] for r in whole} == {r.doc_id for r in plan.collect()}


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_near_the_lower_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 4000).astype(int) + 1, 1, 2048)
    counts = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
    gaps: list[int] = []  # plain best fit decreasing, one piece at a time
    for x in sorted(lengths.tolist(), reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(2048 - x)
    bins = sum(n for _, n in packing.plan_packing(counts))
    assert bins <= len(gaps) + 1 and bins <= -(-int(lengths.sum()) // 2048) * 1.01 + 1


def test_sequences(spark, library):
    d = docs(spark, [(1, "word " * 3000), (2, "a"), (3, None)])
    placed = packing.pack(d)
    seqs = {r.sequence_id: r.ids for r in packing.sequences(d, placed).collect()}
    ids = {1: library("word " * 3000) + [0], 2: library("a") + [0], 3: [0]}
    for r in placed.collect():
        assert seqs[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length]
