"""Exact byte-level BPE ids from the tokenizers library, each distinct chunk of text encoded once.

The ids are those of ``encode(text, add_special_tokens=False)`` of the tokenizer as its file has it: no
special token is added, but the text of one that stands in a document gets its id.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from specgraph.llm.text_arrays import ChunkCache

TOKENIZER_FILE = "byte_bpe_50k.json"
#: Chunks kept by one Python worker; then the cache starts anew.
CACHE_CHUNKS = 1_000_000
#: Bytes of an Arrow batch that are worked on together.
BATCH_BYTES = 3 << 20
_BATCH, _ROW = 256, 300


def default_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """encode(column) gives the ids of each text (null counts as empty) as unsigned little-endian arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        self.led = np.array([(self.tokenizer.id_to_token(i) or "").startswith(space) for i in range(size)])
        #: Texts of added tokens: the library finds these before it splits a text, so texts that hold one go to it whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = ChunkCache(self.dtype, self._chunks, self._library, CACHE_CHUNKS)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), _BATCH):
            out += [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts[i : i + _BATCH], add_special_tokens=False)]
        return out

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks led by a space are encoded in rows: an id that starts with a space starts the next chunk."""
        led = np.array([c[0] == 32 for c in chunks], bool)
        spaced = [c for c in chunks if c[0] == 32]
        rows = [b"".join(spaced[i : i + _ROW]).decode("utf-8", "surrogatepass") for i in range(0, len(spaced), _ROW)]
        heads = self._library([c.decode("utf-8", "surrogatepass") for c in chunks if c[0] != 32])
        row_ids = np.concatenate([np.zeros(0, self.dtype), *self._library(rows)])
        cuts = np.flatnonzero(self.led[row_ids])
        if len(cuts) != len(spaced):  # the ids of a chunk depend on its neighbours: each is encoded by itself
            row_ids = np.concatenate([np.zeros(0, self.dtype), *(alone := self._library([c.decode("utf-8", "surrogatepass") for c in spaced]))])
            cuts = np.cumsum([0, *map(len, alone)])[:-1]
        lengths = np.empty(len(chunks), np.int64)
        lengths[led] = np.diff(cuts, append=len(row_ids))
        lengths[~led] = [len(x) for x in heads]
        ids = np.empty(int(lengths.sum()), self.dtype)
        of_space = np.repeat(led, lengths)
        ids[of_space] = row_ids
        ids[~of_space] = np.concatenate([np.zeros(0, self.dtype), *heads])
        return ids, lengths

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        out = self.cache.encode(column)
        whole = np.zeros(len(column), bool)
        for content in self.added:
            whole |= pc.fill_null(pc.match_substring(column, content), False).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(whole)
        for i, ids in zip(at.tolist(), self._library(column.take(pa.array(at)).to_pylist()) if len(at) else []):
            out[i] = ids
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def small_batches(batches, limit: int = BATCH_BYTES):
    """Arrow batches cut so that each holds about ``limit`` bytes at most (one row at least)."""
    for b in batches:
        n = max(1, -(-b.nbytes // limit))
        step = max(1, -(-b.num_rows // n))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
