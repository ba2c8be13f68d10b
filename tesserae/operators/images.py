"""Image codecs over rows (…, height, width, channels, data): batches of equal size pass through the NumPy kernels together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.functions import entropy as E
from tesserae.functions import search as S
from tesserae.functions import wavelet as W
from tesserae.operators.arrow import arrow_schema

BATCH = 256
QUANTS = ("raw", "int4", "int3", "xs")
ENTROPY = {"none": E.RAW, "rans": E.RANS, "tans": E.TANS}
KINDS = ("u8", "i8", "ll4")
SECTION = "struct<method:int,blob:binary>"
XS = f"struct<u8:{SECTION},i8:{SECTION},ll4:{SECTION},meta:array<array<int>>>"


def stacks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, images (n, h, w, c)) of the sizes in a batch."""
    shape = np.stack([b.column(c).to_numpy() for c in ("height", "width", "channels")], 1)
    data = b.column("data").to_pylist()
    for size in np.unique(shape, axis=0):
        rows = np.flatnonzero((shape == size).all(1))
        for k in range(0, len(rows), BATCH):
            own = rows[k:k + BATCH]
            yield own, np.frombuffer(b"".join(data[i] for i in own), np.uint8).reshape(len(own), *size.tolist())


def map_images(df: DataFrame, fn: Callable[[np.ndarray], list[dict]], schema: str) -> DataFrame:
    """df's columns and those of `schema`, which fn gives as a dict for each image of a stack."""
    own, types = df.columns, arrow_schema(schema)
    kinds = df.schema.fields
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", " + schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4 * BATCH):
                b = whole.slice(at, 4 * BATCH)
                got: list = [None] * b.num_rows
                for rows, images in stacks(b):
                    for i, r in zip(rows, fn(images), strict=True):
                        got[i] = r
                if got:
                    yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[f.name] for r in got], f.type) for f in types)], names=[*own, *types.names])

    return df.mapInArrow(run, full)


def blockwise(images: np.ndarray, bits: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scales) of x / 127.5 - 1 in symmetric blocks of each image."""
    n, top = len(images), {4: 7, 3: 3}[bits]
    flat = (images.reshape(n, -1).astype(np.float32) / np.float32(127.5) - np.float32(1)).astype(np.float64)
    x = np.pad(flat, ((0, 0), (0, -flat.shape[1] % group))).reshape(n, -1, group)
    s = S.bf16(np.maximum(np.abs(x).max(2), 1e-8) / top)
    q = np.clip(np.rint((x / s[:, :, None]).astype(np.float32)), -top - 1, top)
    return q.astype(np.int8).reshape(n, -1)[:, : flat.shape[1]], s


def unblockwise(q: np.ndarray, s: np.ndarray, group: int) -> np.ndarray:
    x = q * s.repeat(group, 1)[:, : q.shape[1]]
    return np.clip(np.rint((x + 1) * 127.5), 0, 255).astype(np.uint8)


def xs_encode(images: np.ndarray, mode: str = "balanced", method: str = "rans", tables: dict | None = None, half_chroma: bool | None = None, codebook: np.ndarray = W.CODEBOOK, block: int = 256) -> list[dict]:
    """Adaptive wavelet, sparse streams, entropy-coded sections; the table of offsets is never coded."""
    q_scale, lamb = W.PRESETS[mode]
    coded, half = W.adaptive_encode(images, None, q_scale, lamb, (mode not in W.FULL_CHROMA) if half_chroma is None else half_chroma, codebook)
    arenas = W.arena_pack_all(coded, half)
    kw = lambda kind: ({"tables": tables[kind], "embed": False, "block": block} if tables else {"block": block}) if method == "tans" else {}
    u8 = E.pack([a["u8"] for a in arenas], ENTROPY[method], **kw("u8"))
    i8 = E.pack([a["i8"] for a in arenas], ENTROPY[method], **kw("i8"))
    ll4 = [(E.RAW, a["ll4"]) for a in arenas] if method == "none" else E.pack_planar([a["ll4"] for a in arenas], ENTROPY[method], **kw("ll4"))
    cell = lambda x: {"method": x[0], "blob": x[1]}
    return [{"u8": cell(u), "i8": cell(i), "ll4": cell(l), "meta": a["meta"]} for u, i, l, a in zip(u8, i8, ll4, arenas, strict=True)]


def xs_arenas(rows: list[dict], tables: dict | None = None) -> list[dict]:
    """Arenas (u8, i8, ll4, meta) of coded rows; a damaged section raises."""
    def sections(kind: str, undo) -> list[bytes]:
        got = undo([(r[kind]["method"], r[kind]["blob"]) for r in rows], tables[kind] if tables else None)
        for x in got:
            if isinstance(x, E.CorruptSection):
                raise x
        return got

    u8, i8, ll4 = sections("u8", E.unpack), sections("i8", E.unpack), sections("ll4", E.unpack_planar)
    return [{"u8": u, "i8": i, "ll4": l, "meta": r["meta"]} for u, i, l, r in zip(u8, i8, ll4, rows, strict=True)]


def xs_decode(rows: list[dict], half_chroma: bool, h: int, w: int, tables: dict | None = None, codebook: np.ndarray = W.CODEBOOK) -> list[np.ndarray]:
    """Images back."""
    return list(W.adaptive_decode(W.arena_unpack_all(xs_arenas(rows, tables), half_chroma, h, w), half_chroma, h, w, codebook)) if rows else []


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    mse = float(((a.astype(np.float64) - b) ** 2).mean())
    return float("inf") if mse == 0 else 20 * float(np.log10(255 / np.sqrt(mse)))


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over channels of structural similarity of whole planes; (h, w, c)."""
    x, y = (v.reshape(-1, v.shape[-1]).astype(np.float64) for v in (a, b))
    mx, my, c1, c2 = x.mean(0), y.mean(0), 6.5025, 58.5225
    cov = ((x - mx) * (y - my)).mean(0)
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (x.var(0) + y.var(0) + c2))).mean())
