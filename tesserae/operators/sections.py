"""Byte sections: histograms, entropies and coders over a binary column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import entropy as E
from tesserae.operators.arrow import arrow_schema

#: Sections that go through a coder together, and their most bytes when all are as long as the longest.
BATCH, PADDED = 256, 1 << 25


def runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs that go through a coder together: coders pad to the longest, so a very long section goes with few others."""
    at, most = 0, 0
    for i, n in enumerate(map(int, lengths)):
        if i > at and (i - at == BATCH or max(most, n) * (i - at + 1) > PADDED):
            yield at, i - at
            at, most = i, 0
        most = max(most, n)
    if len(lengths):
        yield at, len(lengths) - at


def map_sections(df: DataFrame, key: str, payload: Column, fn: Callable[[list[bytes]], list[list[dict]]], schema: str) -> DataFrame:
    """Rows of `schema` (without the key) that fn gives for each section, with the section's key. A null payload counts as empty."""
    kind, types = df.schema[key].dataType.simpleString(), arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, rows in runs(pc.binary_length(whole.column(1)).to_numpy()):
                b = whole.slice(at, rows)
                got = fn(b.column(1).to_pylist())
                n = [len(rows) for rows in got]
                flat = [r for rows in got for r in rows]
                if flat:
                    keys = b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[f.name] for r in flat], f.type) for f in types)], names=[key, *types.names])

    return df.select(key, F.coalesce(payload.cast("binary"), F.lit("").cast("binary")).alias("__b")).mapInArrow(run, f"`{key}` {kind}, {schema}")


def byte_histogram(df: DataFrame, payload: Column) -> DataFrame:
    """(byte, n) over all sections: 256 counts leave each Arrow batch, the rest is a small aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(x or b"" for x in b.column(0).to_pylist()), np.uint8), minlength=256)
            some = np.flatnonzero(n)
            yield pa.record_batch({"byte": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64())})

    return df.select(payload.cast("binary").alias("b")).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def block_histograms(df: DataFrame, key: str, payload: Column, block: int) -> DataFrame:
    """(key, block, byte, n)."""

    def fn(parts: list[bytes]) -> list[list[dict]]:
        out = []
        for p in parts:
            h = E.block_histograms(p, block)
            r, c = np.nonzero(h)
            out.append([{"block": int(i), "byte": int(j), "n": int(h[i, j])} for i, j in zip(r, c, strict=True)])
        return out

    return map_sections(df, key, payload, fn, "block long, byte long, n long")


def bits_per_byte(h: np.ndarray) -> float:
    p = h[h > 0] / h.sum()
    return float(-(p * np.log2(p)).sum())


def entropies(df: DataFrame, key: str, payload: Column, block: int) -> DataFrame:
    """(key, n_bytes, shannon, block_entropy): bits a byte of whole sections, and of their blocks on average."""

    def fn(parts: list[bytes]) -> list[list[dict]]:
        rows = []
        for p in parts:
            h = E.block_histograms(p, block)
            n = h.sum(1)
            rows.append([{"n_bytes": len(p), "shannon": bits_per_byte(h.sum(0)) if len(p) else 0.0, "block_entropy": float(sum(k * bits_per_byte(x) for k, x in zip(n, h, strict=True)) / len(p)) if len(p) else 0.0}])
        return rows

    return map_sections(df, key, payload, fn, "n_bytes long, shannon double, block_entropy double")


def coded(df: DataFrame, key: str, payload: Column, method: str = "rans", planar: bool = False, **kw) -> DataFrame:
    """(key, method, raw_len, blob): each section stored as it pays."""
    code = {"rans": E.RANS, "tans": E.TANS}[method]

    def fn(parts: list[bytes]) -> list[list[dict]]:
        stored = (E.pack_planar if planar else E.pack)(parts, code, **kw)
        return [[{"method": m, "raw_len": len(p), "blob": b}] for p, (m, b) in zip(parts, stored, strict=True)]

    return map_sections(df, key, payload, fn, "method int, raw_len long, blob binary")


def decoded(df: DataFrame, key: str, planar: bool = False, tables: list | None = None) -> DataFrame:
    """(key, ok, err, data) from (key, method, blob): damage is a value, not an exception."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                got = (E.unpack_planar if planar else E.unpack)(list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)), tables)
                bad = [isinstance(x, E.CorruptSection) for x in got]
                yield pa.record_batch({key: b.column(0), "ok": pa.array([not x for x in bad]), "err": pa.array([str(x) if w else None for x, w in zip(got, bad, strict=True)], pa.string()), "data": pa.array([None if w else x for x, w in zip(got, bad, strict=True)], pa.binary())})

    return df.select(key, "method", "blob").mapInArrow(run, f"`{key}` {kind}, ok boolean, err string, data binary")


def learn_dictionary(df: DataFrame, key: str, payload: Column, k: int, block: int, sample: int = 512) -> list[list[int]]:
    """Frequency tables from the blocks of at most `sample` sections, those of smallest hashed key (a bounded fit on the driver)."""
    rows = df.select(key, payload.cast("binary").alias("b")).orderBy(F.xxhash64(key), key).limit(sample)
    h = [E.block_histograms(bytes(r.b or b""), block) for r in rows.toLocalIterator()]
    return [t.tolist() for t in E.learn_dictionary(np.concatenate(h), k)]
