"""Block quantizers over a column of float arrays: one code row per input row, no shuffle.

Symmetric codes, packing and decoding are Catalyst expressions; the scale searches are NumPy kernels
over Arrow batches (a candidate at a time over all blocks of the batch).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import numerics as N
from tesserae.functions import search as S

MODES = ("sym", "int7", "int6", "int5", "adaptive", "int4", "int3", *(f"amo_{m}" for m in S.PRESETS))
LEVELS = {"sym": 127, "int7": 63, "int6": 31, "int5": 15, "int4": 7, "int3": 3}
CODE = "array<struct<block:int,scale:double,zp:int,winner:int,error:double,q:array<int>>>"


def values(c: str | Column) -> Column:
    return F.transform(c, lambda v: v.cast("double"))


def block_struct(codes: Column) -> Column:
    """Symmetric codes in the layout of CODE: winner -1, error null."""
    return F.transform(codes, lambda b, i: F.struct(i.alias("block"), b["scale"].alias("scale"), F.lit(0).alias("zp"), F.lit(-1).alias("winner"), F.lit(None).cast("double").alias("error"), b["q"].alias("q")))


def encode(df: DataFrame, column: str, mode: str = "amo_balanced", group: int = 32, out: str = "code") -> DataFrame:
    """df with `out`, the codes of each row's array in blocks of `group` values; a null array gives a null code."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; one of {', '.join(MODES)}")
    if group <= 0:
        raise ValueError("group must be positive")
    if mode in LEVELS:
        return df.withColumn(out, F.when(F.col(column).isNotNull(), block_struct(N.symmetric(values(column), group, LEVELS[mode]))))
    search = S.adaptive if mode == "adaptive" else S.quality if mode == "amo_quality" else lambda x: S.amo(x, mode.removeprefix("amo_"))
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(len(kept))
            blocks, size, per_row = cut(x, group)
            if mode == "adaptive":
                q, s, w, e = search(blocks) if len(blocks) else [np.zeros((0, group))] + [np.zeros(0)] * 3
                z = np.zeros(len(s))
            else:
                q, s, z, w, e = search(blocks) if len(blocks) else [np.zeros((0, group))] + [np.zeros(0)] * 4
            number = np.arange(len(size)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
            ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            kind = lambda v, t: pa.array(v.astype(t))
            fields = [kind(number, np.int32), kind(s, np.float64), kind(z, np.int32), kind(w, np.int32), kind(e, np.float64), pa.ListArray.from_arrays(ends(size), kind(q[np.arange(group) < size[:, None]], np.int32))]
            code = pa.ListArray.from_arrays(ends(per_row), pa.StructArray.from_arrays(fields, ["block", "scale", "zp", "winner", "error", "q"]), mask=x.is_null() if x.null_count else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], code], names=[*kept, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` {CODE}"
    return df.select("*", values(column).alias("__x")).mapInArrow(run, schema)


def cut(x: pa.ListArray, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows in blocks: (blocks, group) doubles padded with zeros, values of each block, and blocks of each row; null rows have none."""
    long = x.value_lengths().fill_null(0).to_numpy()
    per_row = -(-long // group)
    size = np.full(int(per_row.sum()), group, dtype=np.int64)
    some = per_row > 0
    size[np.cumsum(per_row)[some] - 1] = long[some] - (per_row[some] - 1) * group
    blocks = np.zeros((len(size), group))
    blocks[np.arange(group) < size[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
    return blocks, size, per_row


def decode(code: Column) -> Column:
    """array<double> on the bfloat16 grid from a code column: (q - zp) * scale."""
    return F.flatten(F.transform(code, lambda b: F.transform(b["q"], lambda q: N.bf16((q - b["zp"]) * b["scale"]))))


def compress(df: DataFrame, column: str, mode: str = "amo_balanced", group: int = 32) -> DataFrame:
    return encode(df, column, mode, group)


def decompress(df: DataFrame, code: str = "code", out: str = "decoded") -> DataFrame:
    return df.withColumn(out, decode(F.col(code)))


def bytes_per_value(mode: str, group: int) -> float:
    return {"int4": 0.5, "int3": 0.375}.get(mode, 1.0) + (3 if mode.startswith("amo") else 2) / group


def coded_values(blocks: np.ndarray, mode: str) -> np.ndarray:
    """What blocks decode to in a mode."""
    if mode in LEVELS:
        top, ok = LEVELS[mode], np.isfinite(blocks)
        v = np.where(ok, blocks, 0.0)
        s = S.bf16(S.f32(np.maximum(np.abs(v).max(1), 1e-8) / top))[:, None]
        return S.bf16(np.where(ok, np.clip(np.rint((v / s).astype(np.float32)), -top - 1, top), 0) * s)
    if mode == "adaptive":
        q, s, _, _ = S.adaptive(blocks)
        return S.bf16(q * s[:, None])
    q, s, z, _, _ = S.quality(blocks) if mode == "amo_quality" else S.amo(blocks, mode.removeprefix("amo_"))
    return S.bf16((q - z[:, None]) * s[:, None])


def errors(df: DataFrame, column: str, tried: list[tuple[str, int]]) -> DataFrame:
    """(k, mode, group_size, sse, energy) of each (mode, group) in turn: one scan, a row of sums for each Arrow batch."""
    for mode, group in tried:
        if mode not in MODES or group <= 0:
            raise ValueError(f"unknown mode {mode} or group {group}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for mode, group in tried:
                blocks, size, _ = cut(b.column(0), group)
                here = np.arange(group) < size[:, None]
                gone = np.where(here, blocks - coded_values(blocks, mode), 0.0) if len(blocks) else blocks
                sums.append((float((gone * gone).sum()), float((blocks * blocks).sum())))
            yield pa.record_batch({"k": pa.array(range(len(tried)), pa.int32()), "sse": pa.array([x for x, _ in sums], pa.float64()), "energy": pa.array([x for _, x in sums], pa.float64())})

    rows = df.select(values(column).alias("x")).mapInArrow(run, "k int, sse double, energy double").groupBy("k").agg(F.sum("sse").alias("sse"), F.sum("energy").alias("energy"))
    pick = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), F.col("k") + 1)
    return rows.select("k", pick([m for m, _ in tried]).alias("mode"), pick([g for _, g in tried]).alias("group_size"), "sse", "energy")


def flat(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per value: keep columns, pos, x."""
    return df.select(*keep, F.posexplode(values(column)).alias("pos", "x"))


def minifloat_blocks(x: Column, group: int) -> Column:
    """array<double>: 8-bit floats (e4m3) in blocks under a bfloat16 scale, decoded."""
    one = lambda b: N.let(N.bf16(N.f32(N.absmax(N.clean(b)) / 448.0)), lambda s: F.transform(b, lambda v: N.e4m3(N.clamp(N.f32(v / s), -448, 448)) * s))
    return F.flatten(F.transform(N.blocks(x, group), one))


def affine_minmax(x: Column, group: int, top: int = 255) -> Column:
    """array<struct<scale,zp,q>>: min/max range, no search."""

    def one(b: Column) -> Column:
        low, high = F.array_min(N.clean(b)), F.array_max(N.clean(b))
        return N.let(N.bf16(N.f32(F.greatest(high - low, F.lit(1e-8)) / float(top))), lambda s: N.let(N.clamp(F.rint(N.f32(-low / s)), 0, top), lambda z: F.struct(
            s.alias("scale"), z.alias("zp"), F.transform(b, lambda v: N.clamp(F.rint(N.f32(v / s) + z), 0, top)).alias("q"))))

    return F.transform(N.blocks(x, group), one)


def dct_matrix() -> list[list[float]]:
    """Orthonormal 8-point DCT-II."""
    return [[float(np.sqrt((1 if k == 0 else 2) / 8) * np.cos(np.pi * (2 * i + 1) * k / 16)) for i in range(8)] for k in range(8)]


def dequant_linear(df: DataFrame, key: str, code: str, weights: DataFrame, out: str = "y") -> DataFrame:
    """(key, out): decoded vector times a weight table (row int, col int, w double), summed by row. key names each row of df.

    The weights are one model layer; they are joined by column (broadcast only below Spark's own size threshold).
    """
    x = df.select(key, F.posexplode(decode(F.col(code))).alias("col", "x"))
    y = x.join(weights, "col").groupBy(key, "row").agg(F.sum(F.col("x") * F.col("w")).alias("v"))
    return y.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda r: r["v"]).alias(out))
