"""Byte-level BPE with a rank queue on a hierarchical bitmap.

Merges are driven by rank.  A bucket for each rank holds the linked-list
positions whose pair has that rank; three levels of bitmaps tell which buckets
are filled, and find-first-set picks the next rank in a few steps whatever the
length of the input.  Positions are never removed from buckets: an entry whose
pair has changed since is stale and is skipped when its bucket comes up.  A
bucket is applied as one array operation, so one queue runs over many
pre-tokens laid end to end, or over one very long pre-token.

That is right as long as no merge of a bucket makes a pair of lower rank, which
would have to go before the rest of the bucket.  A pre-token in which one does
leaves the common queue with the tokens it has then and goes on by itself, one
merge at a time, on the same kind of queue: its buckets are heaps of positions.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.llm.encoders import default_path, small_batches
from specgraph.llm.text_arrays import ChunkCache

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Bytes of text whose unseen chunks are merged in one queue.
GROUP_BYTES = 12 << 20
#: Chunks kept by one worker; then the cache starts anew.
CACHE_CHUNKS = 700_000
NONE = np.int32(2**31 - 1)


class RankQueue:
    """Buckets of positions by rank; the filled ones are marked in three levels of 64-bit words."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        """The bucket of a rank, marked as filled."""
        bucket = self.buckets.get(rank)
        if bucket is None:
            bucket = self.buckets[rank] = []
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        return bucket

    def lowest(self) -> int:
        """The lowest filled rank, -1 if there is none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        return b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1

    def clear(self, rank: int) -> list:
        """Take the bucket of a rank out."""
        a, b = rank >> 12, rank >> 6
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        return self.buckets.pop(rank)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest filled rank and its positions, ascending and distinct."""
        if (rank := self.lowest()) < 0:
            return None
        parts = self.clear(rank)
        return rank, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Bpe:
    """encode() as the tiktoken library would, without special tokens; decode() gives the bytes back."""

    def __init__(self, path: str, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.vocabulary: list[bytes] = [b""] * self.size
        for b, r in ranks.items():
            self.vocabulary[r] = b
        self.decimal = [str(i) for i in range(self.size)]
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(ranks[b[:i]], ranks[b[i:]]): r for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks}
        keys = np.array([a * self.size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(pairs.values()), np.int32)[order]
        self.pairs = dict(zip(keys.tolist(), pairs.values()))
        #: Tokens with a pair of lower rank than their own: a merge into one may make a pair that goes first.
        self.early = {t for (a, b), r in pairs.items() for t in (a, b) if r < t}
        self.cache = ChunkCache(np.dtype("<u4"), self._chunks, self.encode_texts, CACHE_CHUNKS)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        own = np.repeat(np.arange(len(pieces)), lengths)
        ends = np.cumsum(lengths)
        # Index n stands for "none" on either side.
        token = np.append(self.byte_rank[data], np.int32(-1))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        filled = lengths > 0
        after[ends[filled] - 1] = n
        before[(ends - lengths)[filled]] = n
        pair = np.append(self.pair_ranks(token[:-1], token[after[:n]]), NONE)
        queue = RankQueue(self.size)

        def push(at: np.ndarray) -> None:
            rank = pair[at]
            at, rank = at[rank != NONE], rank[rank != NONE]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            start = 0
            for end in [*cuts.tolist(), len(at)]:
                queue.bucket(int(rank[start])).append(at[start:end])
                start = end

        push(np.arange(n))
        alone = np.zeros(len(pieces), bool)  # pre-tokens that have left the queue
        while (item := queue.pop()) is not None:
            rank, at = item
            at = at[(pair[at] == rank) & ~alone[own[at]]]  # the others are stale
            if rank in self.early and len(at):
                same = np.full(len(at), rank, np.int32)
                ahead = np.minimum(self.pair_ranks(token[before[at]], same), self.pair_ranks(same, token[after[after[at]]])) < rank
                if self.pairs.get(rank * self.size + rank, NONE) < rank:
                    ahead |= np.isin(after[after[at]], at)
                if ahead.any():
                    alone[own[at[ahead]]] = True
                    at = at[~alone[own[at]]]
            if not len(at):
                continue
            if len(at) > 1:
                follows = np.r_[False, at[1:] == after[at[:-1]]]
                if follows.any():  # a run of overlapping pairs: every other one from the left
                    i = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(follows, 0, i))
                    late = (i - begin) & 1 == 1
                    at = at[~late]
            gone = after[at]
            right = after[gone]
            token[at], token[gone] = rank, -1
            pair[gone] = NONE
            after[at], before[right] = right, at
            left = before[at]
            touched = np.concatenate([at, left[left < n]])
            touched = np.unique(touched) if len(touched) > 1 else touched
            pair[touched] = self.pair_ranks(token[touched], token[after[touched]])
            push(touched)
        alive = np.flatnonzero(token[:n] >= 0)
        ids, counts = token[alive], np.bincount(own[alive], minlength=len(pieces))
        out = np.split(ids, np.cumsum(counts)[:-1]) if pieces else []
        for i in np.flatnonzero(alone).tolist():
            out[i] = np.array(self._merge_one(out[i].tolist()), np.int32)
        return out

    def _merge_one(self, token: list[int]) -> list[int]:
        """The rest of the merges of one pre-token, one at a time: the lowest rank, of equal ones the leftmost."""
        n, size, pairs = len(token), self.size, self.pairs
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank_at = [pairs.get(a * size + b, -1) for a, b in zip(token, token[1:])] + [-1]
        queue = RankQueue(size)
        for i, r in enumerate(rank_at):
            if r >= 0:
                queue.bucket(r).append(i)  # ascending, so a heap
        while (rank := queue.lowest()) >= 0:
            heap = queue.buckets[rank]
            while heap:
                i = heapq.heappop(heap)
                if rank_at[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                token[i], token[j], rank_at[j], after[i] = rank, -1, -1, k
                if k >= 0:
                    before[k] = i
                h, ahead = before[i], False
                for p, q in ((h, i), (i, k)):
                    if p >= 0:
                        r = rank_at[p] = pairs.get(token[p] * size + token[q], -1) if q >= 0 else -1
                        if r >= 0:
                            heapq.heappush(queue.bucket(r), p)
                            ahead |= r < rank
                if ahead:
                    break
            if not heap:
                queue.clear(rank)
        return [t for t in token if t >= 0]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, each match of the pattern merged by itself and equal ones once."""
        cut = [[m.encode("utf-8", "surrogatepass") for m in self.pattern.findall(t)] for t in texts]
        known: dict[bytes, bytes] = {}
        rest = []
        for p in {p for parts in cut for p in parts}:
            r = self.ranks.get(p)
            if r is None:
                rest.append(p)
            else:
                known[p] = r.to_bytes(4, "little")
        for p, ids in zip(rest, self.merge(rest)):
            known[p] = ids.astype("<u4").tobytes()
        return [np.frombuffer(b"".join([known[p] for p in parts]), "<u4") for parts in cut]

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done = self.encode_texts([c.decode("utf-8", "surrogatepass") for c in chunks])
        return np.concatenate([np.zeros(0, "<u4"), *done]), np.array([len(x) for x in done], np.int64)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty.  Only chunks not seen before are cut by the pattern and merged."""
        return self.cache.encode(column)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_LOADED: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    """One encoder for each Python worker and vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(path, pattern)
    return _LOADED[path, pattern]


def _run(path: str, pattern: str, digest: bool):
    def run(batches):
        bpe = load(path, pattern)
        for batch in small_batches(batches, GROUP_BYTES):
            keys, encoded = batch.column(0), bpe.encode(batch.column(1))
            for i in range(0, len(keys), 2000):
                part = encoded[i : i + 2000]
                out = {"doc_id": keys.slice(i, 2000), "n_tokens": pa.array([len(x) for x in part], pa.int64())}
                if digest:
                    lists = [x.tolist() for x in part]
                    out["ids_sha256"] = pa.array([hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, x)).encode()).hexdigest() for x in lists], pa.string())
                    out["decoded_sha256"] = pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in lists], pa.string())
                else:
                    out["ids"] = pa.array([x.astype(np.int32) for x in part], pa.list_(pa.int32()))
                    out["decoded"] = pa.array([bpe.decode(x.tolist()) for x in part], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return run


def encode_column(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), or with ``digest`` the SHA-256 of the decimal ids and of the decoded bytes.

    Null texts count as empty; null and repeated keys are kept row by row.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary")
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_run(ranks or default_path(RANK_FILE), pattern, digest), schema)
