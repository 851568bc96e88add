"""The rank queue against the tiktoken library."""

import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specgraph.llm import bpe as B
from specgraph.llm.encoders import default_path

TEXTS = ["", " ", "it's  here", "x \n y", "x\n \ty", "  lead", "trail ", "a\n ", "a\n  b", "naïve été  　 ß", "a" * 3000, "ab" * 999, "The cat.\n\nThe 12 345 cats!", "<|endoftext|>", "\x1c \x1d", "🙂 🙂🙂"]


@pytest.fixture(scope="module")
def ours():
    import public_tokenizers as P

    return B.Bpe(default_path(B.RANK_FILE), P.PATTERN)


@pytest.fixture(scope="module")
def library(ours):
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ours.ranks, special_tokens={}).encode_ordinary


def test_texts(ours, library):
    for _ in range(3):  # again from the caches
        got = ours.encode(pa.array([*TEXTS, None], pa.string()))
        assert [x.tolist() for x in got] == [library(t) for t in TEXTS] + [[]]
    assert [ours.decode(x.tolist()).decode() for x in got[:-1]] == TEXTS


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aeinrst ehT's.\n\té", max_size=40), max_size=5))
def test_any_texts(ours, library, texts):
    assert [x.tolist() for x in ours.encode(pa.array(texts, pa.string()))] == [library(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["nd", "an", "ing", "er", "e", "th", "s", "ation", "aa", "ß"]), max_size=60), st.integers(1, 4))
def test_unbroken_texts(ours, library, parts, times):
    text = "".join(parts) * times
    assert ours.encode_texts([text])[0].tolist() == library(text)
    one = [ours.byte_rank[b] for b in text.encode()]
    if len(ours.pattern.findall(text)) == 1 and text.encode() not in ours.ranks:
        assert ours._merge_one([int(x) for x in one]) == library(text)


def test_very_long_pre_tokens(ours, library):
    """Pre-tokens full of merges that make pairs of lower rank, and a random one: right, and time in proportion to the length."""
    rng = np.random.default_rng(4)
    for text in ("nd" * 40_000, "".join(rng.choice(list("etaoinshr"), 40_000)), "ingrand" * 6_000):
        assert ours.encode_texts([text])[0].tolist() == library(text)

    def seconds(n: int) -> float:
        start = time.process_time()
        ours.encode_texts(["nd" * n])
        return time.process_time() - start

    short, long = min(seconds(20_000) for _ in range(3)), min(seconds(80_000) for _ in range(2))
    assert long < 8 * short + 0.2


def test_tokens_with_early_pairs_are_known(ours):
    for r in list(ours.early)[:20]:
        assert any(v < r for v in ours.values[(ours.keys // ours.size == r) | (ours.keys % ours.size == r)])


def test_queue_order():
    q = B.RankQueue(60000)
    for r in (50000, 3, 4096, 64, 63):
        q.bucket(r).append(np.array([r]))
    q.bucket(64).append(np.array([1, 64]))
    assert [q.pop()[0] for _ in range(5)] == [3, 63, 64, 4096, 50000]
    assert q.pop() is None


def test_query_columns(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x y"), (2, None)]
    d = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, ids int")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(k, len(ids := library(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for k, t in rows]
    got = [tuple(r) for r in B.encode_column(d, digest=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert B.encode_column(d.limit(0)).count() == 0
    assert {r.doc_id: bytes(r.decoded) for r in B.encode_column(d.where("doc_id = 9")).collect()} == {9: TEXTS[9].encode()}
