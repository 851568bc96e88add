"""Image columns: Netpbm and BMP bytes to arrays, NPY tiles, area resizing and difference hashes.

All images become arrays of shape (height, width) or (height, width, 3).  An
image is stored losslessly as one NPY array of square tiles,
``(rows, columns, tile, tile[, 3])``; the right and lower edges are filled with
zeros and ``height``/``width`` tell what to cut off again.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.llm.encoders import small_batches
from specgraph.storage import write

TILE = 24
STORED = "key long, n_bytes long, height int, width int, npy binary"

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6.  Bitmaps give 0 for black and 255 for white; maximum values over 255 give uint16."""
    kind = data[:2]
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("netpbm: the header ends early")
        head.append(int(m[1]))
        at = m.end()
    width, height = head[:2]
    top = head[2] if len(head) > 2 else 1
    if not 0 < top < 1 << 16:
        raise ValueError("netpbm: maximum value out of range")
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    dtype = np.uint8 if top < 256 else np.dtype(">u2")
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*|[^01]", b"", data[at:])[:n], np.uint8) - 48
        out = ((1 - bits) * 255).astype(np.uint8)
    elif kind in (b"P2", b"P3"):
        out = np.array(re.sub(rb"#[^\n]*", b" ", data[at:]).split()[:n], np.int64).astype(np.uint8 if top < 256 else np.uint16)
    elif kind == b"P4":
        stride = -(-width // 8)
        rows = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        return ((1 - np.unpackbits(rows, axis=1)[:, :width]) * 255).astype(np.uint8)
    elif kind in (b"P5", b"P6"):
        out = np.frombuffer(data, dtype, n, at + 1)
        out = out if top < 256 else out.astype(np.uint16)
    else:
        raise ValueError(f"netpbm: unknown kind {kind!r}")
    if out.size != n:
        raise ValueError("netpbm: samples are missing")
    return out.reshape((height, width) if channels == 1 else (height, width, 3))


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; palettes are applied, grey ones give two dimensions."""
    if data[:2] != b"BM":
        raise ValueError("bmp: no BM mark")
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("bmp: compression or depth isn't supported")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    if bits == 8:
        index = raw[:, :width]
    elif bits == 4:
        index = np.stack([raw >> 4, raw & 15], 2).reshape(rows, -1)[:, :width]
    else:
        index = np.unpackbits(raw, axis=1)[:, :width]
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.zeros((1 << bits, 3), np.uint8)
    palette[:colours] = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
    image = palette[index]
    return np.ascontiguousarray(image[:, :, 0]) if (palette == palette[:, :1]).all() else image


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def to_tiles(image: np.ndarray, tile: int = TILE) -> np.ndarray:
    h, w = image.shape[:2]
    rows, cols = -(-h // tile), -(-w // tile)
    if (rows * tile, cols * tile) != (h, w):
        image = np.pad(image, [(0, rows * tile - h), (0, cols * tile - w)] + [(0, 0)] * (image.ndim - 2))
    return image.reshape(rows, tile, cols, tile, *image.shape[2:]).swapaxes(1, 2)


def from_tiles(tiles: np.ndarray, height: int, width: int) -> np.ndarray:
    rows, cols, tile = tiles.shape[:3]
    return tiles.swapaxes(1, 2).reshape(rows * tile, cols * tile, *tiles.shape[4:])[:height, :width]


def to_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each new sample covers, from one integral image (double precision)."""

    def sums(table: np.ndarray, n: int) -> np.ndarray:
        """Integral over n equal spans of the first axis; table is cumulative with a leading zero."""
        edge = np.arange(n + 1) * ((len(table) - 1) / n)
        low = np.minimum(edge.astype(np.int64), len(table) - 2)
        part = (edge - low).reshape(-1, *[1] * (table.ndim - 1))
        return np.diff(table[low] + (table[low + 1] - table[low]) * part, axis=0)

    h, w = image.shape[:2]
    table = np.zeros((h + 1, w + 1, *image.shape[2:]))
    table[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)
    columns = sums(np.moveaxis(sums(table, height), 1, 0), width)
    return np.moveaxis(columns, 1, 0) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: is each sample of the 8 x 9 reduction brighter than its right neighbour?"""
    grey = image if image.ndim == 2 else image.mean(2)
    small = area_resize(grey, 8, 9)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def payload_of(text: str | None, unit: int = TILE * TILE) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (unit - len(raw) % unit if len(raw) % unit or not raw else 0)


def _texts_to_images(batches):
    """A text's bytes become a greyscale image, 24 samples wide, as a binary PGM."""
    for batch in small_batches(batches):
        rows = [payload_of(t) for t in batch.column(1).to_pylist()]
        images = [encode_pgm(np.frombuffer(p, np.uint8).reshape(-1, TILE)) for _, p in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array(images, pa.binary())], ["key", "n_bytes", "content"])


def text_images(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, content): one PGM for each text; null counts as empty, one tile of 255."""
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_texts_to_images, "key long, n_bytes long, content binary")


def _tile(batches):
    for batch in small_batches(batches):
        images = [decode(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([x.shape[0] for x in images], pa.int32()), pa.array([x.shape[1] for x in images], pa.int32()), pa.array([to_npy(to_tiles(x)) for x in images], pa.binary())],
            ["key", "n_bytes", "height", "width", "npy"],
        )


def store_tiles(images: DataFrame) -> DataFrame:
    """Decode (key, n_bytes, content), write NPY tiles to the shared folder and return the table read back."""
    return write(images.mapInArrow(_tile, STORED), "tiles").df


def _features(batches):
    for batch in small_batches(batches):
        out = []
        for key, n, h, w, npy in zip(*(batch.column(i).to_pylist() for i in range(5))):
            image = from_tiles(from_npy(npy), h, w)
            payload = image.tobytes()
            out.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(npy), hashlib.sha256(npy).hexdigest(), difference_hash(image)))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def features(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold: sizes, digests and the difference hash of the decoded samples."""
    return stored.select("key", "n_bytes", "height", "width", "npy").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
