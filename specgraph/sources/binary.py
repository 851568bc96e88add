"""Peak lists packed as scan files pack them, and back, for Arrow batches of (key, peaks)."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa

from specgraph.sources.xmlscan import decode


def pack(batches):
    for batch in batches:
        out = [base64.b64encode(zlib.compress(np.array([(p["mz"], p["intensity"]) for p in peaks], ">f4").tobytes())) for peaks in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node_id", "packed"])


def unpack(batches):
    kind = pa.list_(pa.struct([("mz", pa.float32()), ("intensity", pa.float32())]))
    for batch in batches:
        values = [decode(x, 32, "zlib", ">").reshape(-1, 2).tolist() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"mz": m, "intensity": i} for m, i in v] for v in values], kind)], ["node_id", "peaks"])
