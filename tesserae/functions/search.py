"""Scale searches over blocks, as NumPy kernels on (blocks, group) matrices of doubles.

Candidates are tried one after another over all blocks of a batch at once, so memory is one matrix
and the first of equal errors wins. Errors add up in the order of the values.
"""

from __future__ import annotations

import numpy as np

#: Name -> (candidates, least multiplier, greatest multiplier).
PRESETS = {
    "fast": (16, 0.95, 1.05),
    "balanced": (32, 0.95, 1.05),
    "accurate": (48, 0.95, 1.10),
    "max": (64, 0.85, 1.10),
    "quality": (64, 0.85, 1.10),
}


def f32(x: np.ndarray) -> np.ndarray:
    """Values in single precision, for scales that are defined by their single."""
    return np.asarray(x, np.float32)


def bf16_bits(x: np.ndarray) -> np.ndarray:
    """Bit patterns of the nearest bfloat16, half to even. A double is rounded once: on the way its single is cut and its last bit set if anything was lost, so that no half way point is made up."""
    x = np.asarray(x)
    f = np.asarray(x, np.float32)
    u = f.view(np.uint32).astype(np.uint64)
    lost = (f != x) & ~np.isnan(x)
    u = np.where(lost, (u - (np.abs(f) > np.abs(x))) | np.uint64(1), u)
    return ((u + 0x7FFF + ((u >> 16) & 1)) >> 16).astype(np.int64)


def from_bits(bits: np.ndarray) -> np.ndarray:
    return (np.asarray(bits).astype(np.uint32) << 16).view(np.float32).astype(np.float64)


def bf16(x: np.ndarray) -> np.ndarray:
    return from_bits(bf16_bits(x))


def fold(rows: np.ndarray) -> np.ndarray:
    """Sums of the rows, from left to right."""
    out = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        out = out + rows[:, k]
    return out


def to_blocks(x: np.ndarray, group: int) -> np.ndarray:
    return np.pad(x, (0, -len(x) % group)).reshape(-1, group)


def best_of(n: int, score) -> list[np.ndarray]:
    """Element-wise best of n candidates; score(i) gives (error, *payload) arrays."""
    best: list[np.ndarray] | None = None
    for i in range(n):
        now = [*map(np.asarray, score(i))]
        if best is None:
            best = now
            continue
        better = now[0] < best[0]
        best = [np.where(better if a.ndim == 1 else better[:, None], b, a) for a, b in zip(best, now, strict=True)]
    return best or []


def adaptive(x: np.ndarray, candidates: int = 31, low: float = 0.90, high: float = 1.05) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, winner, its error): symmetric search, then codes for the stored scale."""
    ok = np.isfinite(x)
    v = np.where(ok, x, 0.0)
    s0 = np.maximum(np.abs(v).max(1), 1e-8) / 127.0

    def score(i: int):
        s = s0 * (low + (high - low) * i / (candidates - 1))
        q = np.clip(np.rint(v / s[:, None]), -128, 127)
        return fold((v - q * s[:, None]) ** 2), s, np.full(len(v), i)

    error, s, i = best_of(candidates, score)
    s = bf16(s)
    return np.where(ok, np.clip(np.rint(v / s[:, None]), -128, 127), 0).astype(np.int64), s, i.astype(np.int64), error


def amo(x: np.ndarray, mode: str = "balanced", candidates: int | None = None, low: float | None = None, high: float | None = None):
    """(q, stored scale, zero point, winner, its error): affine search; codes use the scale before it is stored."""
    n, lo, hi = PRESETS[mode]
    n, lo, hi = candidates or n, lo if low is None else low, hi if high is None else high
    ok = np.isfinite(x)
    v = np.where(ok, x, 0.0)
    bottom = v.min(1)
    s0 = np.maximum(v.max(1) - bottom, 1e-8) / 255.0

    def codes(s: np.ndarray):
        zp = np.clip(np.rint(-bottom / s), 0, 255)
        return np.clip(np.rint(v / s[:, None] + zp[:, None]), 0, 255), zp

    def score(i: int):
        s = s0 * (lo + (hi - lo) * i / max(n - 1, 1))
        q, zp = codes(s)
        return fold(np.where(ok, v - (q - zp[:, None]) * s[:, None], 0.0) ** 2), s, zp, np.full(len(v), i)

    error, s, zp, i = best_of(n, score)
    q, _ = codes(s)
    return np.where(ok, q, zp[:, None]).astype(np.int64), bf16(s), zp.astype(np.int64), i.astype(np.int64), error


def nearest_codes(v: np.ndarray, s: np.ndarray, zp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes whose decoded bfloat16 is nearest, among the rounded one and its neighbours (that order wins ties), and squared errors."""
    middle = np.rint(v / s[:, None] + zp[:, None])
    tries = [np.clip(middle + d, 0, 255) for d in (0, -1, 1)]
    errors = np.stack([(v - bf16((q - zp[:, None]) * s[:, None])) ** 2 for q in tries])
    pick = errors.argmin(0)
    return np.take_along_axis(np.stack(tries), pick[None], 0)[0], np.take_along_axis(errors, pick[None], 0)[0]


def quality(x: np.ndarray, low: float = 0.85, high: float = 1.10, most: int = 64):
    """(q, scale, zero point, scale bits, error): all bfloat16 scales between two bounds, scored on decoded values; the range holds 0."""
    ok = np.isfinite(x)
    v = np.where(ok, x, 0.0)
    bottom, top = np.minimum(v.min(1), 0), np.maximum(v.max(1), 0)
    s0 = np.maximum(top / 255.0 - bottom / 255.0, 1e-8 / 255.0)
    first, last = bf16_bits(f32(s0 * low)), bf16_bits(f32(s0 * high))

    def score(i: int):
        bits = np.minimum(first + i, last)
        s = from_bits(bits)
        zp = np.clip(np.rint(-bottom / s), 0, 255)
        q, e = nearest_codes(v, s, zp)
        return fold(np.where(ok, e, 0.0)), bits, zp, q

    error, bits, zp, q = best_of(min(most, int((last - first).max(initial=0)) + 1), score)
    return np.where(ok, q, zp[:, None]).astype(np.int64), from_bits(bits), zp.astype(np.int64), bits.astype(np.int64), error


def scale_search(x: np.ndarray, method: str):
    """(q, scale, zero point) by one of the research searches."""
    lo0, hi0 = x.min(1), x.max(1)
    if method == "zero_range":
        lo0, hi0 = np.minimum(lo0, 0), np.maximum(hi0, 0)
    s0 = np.maximum(hi0 - lo0, 1e-8) / 255.0
    aware = method not in ("stored_scale", "zero_range")
    bottom = x.min(1)

    def rate(s: np.ndarray):
        s = bf16(f32(s))
        zp = np.clip(np.rint(-bottom / s), 0, 255)
        if aware:
            q, e = nearest_codes(x, s, zp)
        else:
            q = np.clip(np.rint(x / s[:, None] + zp[:, None]), 0, 255)
            e = (x - bf16((q - zp[:, None]) * s[:, None])) ** 2
        return fold(e), q, s, zp

    if method in ("stored_scale", "decoded_score", "zero_range"):
        _, q, s, zp = best_of(32, lambda i: rate(s0 * (0.95 + 0.10 * i / 31)))
    else:
        low, high = (0.5, 2.0) if method == "wide_grid" else (0.85, 1.10)
        first, last = bf16_bits(f32(s0 * low)), bf16_bits(f32(s0 * high))
        _, q, s, zp = best_of(int((last - first).max(initial=0)) + 1, lambda i: rate(from_bits(np.minimum(first + i, last))))
    for _ in range(3 if method == "lattice_refine" else 0):
        code = q - zp[:, None]
        fit = bf16_bits(f32(np.maximum(fold(x * code) / np.maximum(fold(code * code), 1), 1e-12)))
        options = [s, *(from_bits(np.maximum(fit + d, 1)) for d in range(-2, 3))]
        _, q, s, zp = best_of(len(options), lambda i, options=options: rate(options[i]))
    return q.astype(np.int64), s, zp.astype(np.int64)
