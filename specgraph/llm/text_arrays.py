"""Arrow string columns as byte arrays: pieces, their hashes, and a cache of pieces seen before.

Everything here is a helper inside tasks; it works on one small Arrow batch at a time.
"""

from __future__ import annotations

import gc
import weakref
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Most rounds of eight bytes that pieces take together.
LANES = 8
_STEP, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Masks of the lowest 0 to 8 bytes.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts); a null text is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece data[start:end] that depends on its bytes only.

    Eight bytes at a time go through the finisher, so unlike a polynomial in the
    bytes it has no families of texts that share a value.  Pieces over ``LANES``
    times eight bytes are hashed one by one.
    """
    lengths = (ends - starts).astype(np.int64)
    out = lengths.astype(np.uint64) * _M2
    if not len(lengths):
        return out
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)], padded[len(data) :] = data, 0
    words = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    live = np.flatnonzero(lengths <= 8 * LANES)
    at, left = starts[live].astype(np.int64), lengths[live]
    h = out[live]
    with np.errstate(over="ignore"):
        while len(live):
            h = mix((h ^ (words[at] & _KEEP[np.minimum(left, 8)])) + _STEP)
            done = left <= 8
            out[live[done]] = h[done]
            more = ~done
            live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(lengths > 8 * LANES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all runs one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


_CACHES: weakref.WeakSet = weakref.WeakSet()


def forget() -> None:
    """Empty the caches that an earlier operator has left in this Python worker."""
    for cache in _CACHES:
        cache.empty()
    gc.collect()
    pa.default_memory_pool().release_unused()


class ChunkCache:
    """Ids of texts from the ids of their space-led chunks.

    A tokenizer that never lets a token cross the place before a single space
    (unless white space runs over it) gives a text the ids of its chunks, one
    after another.  Equal chunks of a batch are found by hash and compared byte
    by byte; each is then looked up in the cache or encoded by ``encode_new``, which
    gives the ids of all new chunks in one array and their numbers.
    A chunk of a space and more white space, or of a lone space, can't stand
    alone: its text goes to ``encode_whole`` in one piece.
    """

    def __init__(self, dtype: np.dtype, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], encode_whole: Callable[[list[str]], list[np.ndarray]], most: int):
        self.dtype, self.encode_new, self.encode_whole, self.most = dtype, encode_new, encode_whole, most
        self.empty()
        _CACHES.add(self)

    def empty(self) -> None:
        self.entry: dict[bytes, int] = {}
        self.offset, self.length, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 16, self.dtype)
        self.filled = 0

    def _add(self, chunks: list[bytes]) -> None:
        alone = [c for c in chunks if self._stands(c)]
        odd = [c for c in chunks if not self._stands(c)] if len(alone) < len(chunks) else []
        ids, lengths = self.encode_new(alone)
        lengths = np.concatenate([lengths, np.full(len(odd), -1)])
        n, size = len(self.entry), len(ids)
        while n + len(chunks) > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        while self.filled + size > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        held = np.maximum(lengths, 0)
        self.offset[n : n + len(chunks)] = self.filled + np.cumsum(held) - held
        self.length[n : n + len(chunks)] = lengths
        self.pool[self.filled : self.filled + size] = ids
        self.filled += size
        self.entry.update(zip(alone + odd, range(n, n + len(chunks))))

    @staticmethod
    def _stands(chunk: bytes) -> bool:
        """False for a space alone or before more white space; only bytes that may start white space are decoded."""
        if chunk[0] != 32:
            return True
        if len(chunk) == 1:
            return False
        if chunk[1] > 32 and chunk[1] not in (0xC2, 0xE1, 0xE2, 0xE3):
            return True
        return not chunk[1:].decode("utf-8", "surrogatepass")[0].isspace()

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of the column; null counts as empty."""
        data, docs = column_bytes(column)
        if not len(data):
            return [np.zeros(0, self.dtype)] * len(column)
        first = data == 32
        first[docs[:-1][docs[1:] > docs[:-1]]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        hashes = piece_hashes(data, starts, ends)
        _, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = ends - starts
        alike = starts[example][which]
        if (lengths != lengths[example][which]).any() or (data[ragged(alike, lengths)] != data).any():
            return self.encode_whole([x or "" for x in column.to_pylist()])  # two chunks share a hash
        raw = data.tobytes()
        chunks = [raw[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist())]
        if len(self.entry) > self.most:
            self.empty()
        new = [c for c in chunks if c not in self.entry]
        if new:
            self._add(new)
        entry = np.fromiter(map(self.entry.__getitem__, chunks), np.int64, len(chunks))[which]
        n = self.length[entry]
        held = np.maximum(n, 0)
        ids = self.pool[ragged(self.offset[entry], held)]
        chunk_at = np.searchsorted(starts, docs)
        cuts = np.append(0, np.cumsum(held))[chunk_at]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        whole = np.unique(np.searchsorted(docs, starts[n < 0], "right") - 1)
        if len(whole):
            for i, x in zip(whole.tolist(), self.encode_whole(column.take(pa.array(whole)).to_pylist())):
                out[i] = x
        return out
