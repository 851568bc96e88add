"""Image columns: format round trips, resizing against brute force, the query against plain Python."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from specgraph.llm import media as M

GREY = np.arange(35, dtype=np.uint8).reshape(5, 7) * 7
RGB = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)


def bmp(width, height, bits, rows, palette=b"", down=False):
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(rows), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, -height if down else height, 1, bits, 0, len(rows), 0, 0, len(palette) // 4, 0) + palette + rows


def test_netpbm():
    assert (M.decode(M.encode_pgm(GREY)) == GREY).all()
    assert (M.decode(b"P6 7 # wide\n5\n255\n" + RGB.tobytes()) == RGB).all()
    assert (M.decode(b"P2\n2 2\n#x\n9\n1 2\n3 4\n") == [[1, 2], [3, 4]]).all()
    assert (M.decode(b"P3 1 1 255 1 2 3") == [[[1, 2, 3]]]).all()
    assert (M.decode(b"P1\n3 1\n1 0 1") == [[0, 255, 0]]).all()
    assert (M.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    assert M.decode(b"P5 1 1 65535\n\x01\x02")[0, 0] == 258
    for bad in (b"P9 1 1 1", b"P5 9", b"P5 1 1 0\nx", b""):
        with pytest.raises(ValueError):
            M.decode(bad)


def test_bmp():
    grey = b"".join(bytes([i, i, i, 0]) for i in range(256))
    rows = b"".join(r.tobytes() + b"\0" for r in GREY[::-1])
    assert (M.decode(bmp(7, 5, 8, rows, grey)) == GREY).all()
    assert (M.decode(bmp(7, 5, 8, b"".join(r.tobytes() + b"\0" for r in GREY), grey, True)) == GREY).all()
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" * 3 for r in RGB[::-1])
    assert (M.decode(bmp(7, 5, 24, rows)) == RGB).all()
    assert (M.decode(bmp(3, 1, 1, b"\xa0\0\0\0", bytes([0, 0, 0, 0, 255, 255, 255, 0]))) == [[255, 0, 255]]).all()
    assert (M.decode(bmp(3, 1, 4, b"\x01\x20\0\0", bytes([9, 9, 9, 0, 8, 8, 8, 0, 7, 7, 7, 0]))) == [[9, 8, 7]]).all()


@pytest.mark.parametrize("image", [GREY, RGB, np.zeros((24, 24), np.uint8), np.ones((1, 1), np.uint8)])
def test_tiles_round_trip(image):
    back = M.from_tiles(M.from_npy(M.to_npy(M.to_tiles(image, 3))), *image.shape[:2])
    assert back.dtype == image.dtype and (back == image).all()


@pytest.mark.parametrize("shape", [(1, 1), (3, 4), (5, 7), (8, 9), (13, 2)])
def test_area_resize(shape):
    h, w = shape
    fine = np.repeat(np.repeat(GREY.astype(float), h, 0), w, 1)  # every cell of the result is whole here
    want = fine.reshape(h, 5, w, 7).mean((1, 3))
    assert np.allclose(M.area_resize(GREY, h, w), want)


def test_query_columns(spark):
    texts = ["", None, "a" * 576, "b" * 577, "é" * 288, "x" * 200_000, "same", "same"]
    d = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "nokey", "k")], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in M.features(M.store_tiles(M.text_images(d))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576) or b"\xff" * 576
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        npy = M.to_npy(np.frombuffer(payload, np.uint8).reshape(-1, 1, 24, 24))
        assert (r.media_bytes, r.media_sha256) == (len(npy), hashlib.sha256(npy).hexdigest())
        assert len(r.feature) == 16
    assert got[6][1:] == got[7][1:] and got[0][1:] == got[1][1:] and None in got
    assert M.features(M.store_tiles(M.text_images(d.limit(0)))).count() == 0
