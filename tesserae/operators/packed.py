"""Stored form of block codes: packed bytes, 16-bit scales and one byte a block for zero points, as NumPy kernels over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.functions import search as S

STORED = "q binary, scale_bits array<smallint>, zp binary"


def pack_rows(q: np.ndarray, mode: str) -> np.ndarray:
    """(n, bytes) of integer codes (n, values): one byte each, 4-bit codes low nibble first, 3-bit codes (plus 4) eight in three bytes, highest bit first."""
    n, width = q.shape
    if mode == "int4":
        q = np.pad(q, ((0, 0), (0, width % 2))) & 15
        return (q[:, 0::2] | (q[:, 1::2] << 4)).astype(np.uint8)
    if mode == "int3":
        bits = ((q + 4)[:, :, None] >> np.array([2, 1, 0])) & 1
        return np.packbits(bits.reshape(n, -1).astype(np.uint8), axis=1)
    return (q & 255).astype(np.uint8)


def unpack_rows(data: np.ndarray, width: int, mode: str) -> np.ndarray:
    """(n, width) integer codes of packed rows."""
    n = len(data)
    if mode == "int4":
        pair = np.stack([data & 15, data >> 4], 2).reshape(n, -1)[:, :width].astype(np.int32)
        return np.where(pair > 7, pair - 16, pair)
    if mode == "int3":
        bits = np.unpackbits(data, axis=1)[:, : 3 * width].reshape(n, width, 3).astype(np.int32)
        return bits @ np.array([4, 2, 1]) - 4
    return data.astype(np.int32) if mode.startswith("amo") else data.view(np.int8).astype(np.int32)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def blobs(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def store(df: DataFrame, mode: str, code: str = "code") -> DataFrame:
    """df with its code column (all rows of one length, none null) in the stored form."""
    kept = [c for c in df.columns if c != code]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            blocks = b.column(len(kept)).flatten()
            q = blocks.field("q").flatten().to_numpy().reshape(b.num_rows, -1)
            scale = blocks.field("scale").to_numpy().astype(np.float32).reshape(b.num_rows, -1)
            bits = (scale.view(np.uint32) >> np.uint32(16)).astype(np.uint16).view(np.int16)
            zp = blobs(blocks.field("zp").to_numpy().reshape(b.num_rows, -1).astype(np.uint8)) if mode.startswith("amo") else pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], blobs(pack_rows(q, mode)), lists(bits, pa.int16()), zp], names=[*kept, "q", "scale_bits", "zp"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, code).mapInArrow(run, f"{kinds}, {STORED}")


def load(df: DataFrame, mode: str, width: int, group: int, out: str = "decoded") -> DataFrame:
    """df with the stored form replaced by the decoded values: array<double> on the bfloat16 grid."""
    kept = [c for c in df.columns if c not in ("q", "scale_bits", "zp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, bits, zp = (b.column(len(kept) + k) for k in range(3))
            q = unpack_rows(np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(b.num_rows, -1), width, mode)
            scale = (bits.flatten().to_numpy().astype(np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32).reshape(b.num_rows, -1).astype(np.float64)
            spread = lambda x: x.repeat(group, 1)[:, :width]
            if mode.startswith("amo"):
                q = q - spread(np.frombuffer(b"".join(zp.to_pylist()), np.uint8).reshape(b.num_rows, -1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], lists(S.bf16(q * spread(scale)), pa.float64())], names=[*kept, out])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, "q", "scale_bits", "zp").mapInArrow(run, f"{kinds}, {out} array<double>")
