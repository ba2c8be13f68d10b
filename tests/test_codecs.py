import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.functions import entropy as E
from tesserae.functions import search as S
from tesserae.functions import wavelet as W


def relative(x, r):
    return 100 * np.sqrt(((x - r) ** 2).sum() / (x * x).sum())


def test_bf16_matches_bits():
    x = np.random.default_rng(0).normal(size=5000).astype(np.float32)
    u = x.view(np.uint32)
    want = (((u + 0x7FFF + ((u >> 16) & 1)) >> 16) << 16).astype(np.uint32).view(np.float32)
    assert (S.bf16(x) == want).all()


@pytest.mark.parametrize("mode", list(S.PRESETS))
def test_search_errors(mode):
    x = np.random.default_rng(1).normal(size=(400, 32))
    q, s, zp, _, error = S.quality(x) if mode == "quality" else S.amo(x, mode)
    assert relative(x, S.bf16((q - zp[:, None]) * s[:, None])) < 1
    assert (error >= 0).all() and q.min() >= 0 and q.max() <= 255


@pytest.mark.parametrize("group", [16, 24, 32, 48, 64])
def test_quality_is_exhaustive(group):
    x = np.random.default_rng(41).normal(size=(1, group))
    _, _, _, _, error = S.quality(x)
    low, high = min(x.min(), 0), max(x.max(), 0)
    s0 = high / 255 - low / 255
    best = np.inf
    for bits in range(int(S.bf16_bits(s0 * 0.85)), int(S.bf16_bits(s0 * 1.10)) + 1):
        s = float(S.from_bits(np.array(bits)))
        zp = np.clip(np.rint(-low / s), 0, 255)
        best = min(best, ((x[0][:, None] - S.bf16((np.arange(256) - zp) * s)[None]) ** 2).min(1).sum())
    assert error[0] == pytest.approx(best, rel=1e-5, abs=1e-9)


def test_edges():
    odd = np.array([[np.nan, np.inf, -np.inf] + [0.0] * 29, [3.0] * 32, [-3.0] * 32, [0.0] * 32])
    for q, s, zp, *_ in (S.quality(odd), S.amo(odd)):
        r = S.bf16((q - zp[:, None]) * s[:, None])
        assert np.isfinite(r).all() and (r[0, :3] == 0).all() and (r[3] == 0).all()
    q, s, zp, *_ = S.quality(odd)
    assert abs(S.bf16((q - zp[:, None]) * s[:, None])[1] - 3).max() < 0.02
    q, s, *_ = S.adaptive(odd)
    assert (q[0, :3] == 0).all() and (q[3] == 0).all()


@pytest.mark.parametrize("method", ["stored_scale", "decoded_score", "zero_range", "wire_grid", "lattice_refine", "wide_grid"])
def test_scale_searches(method):
    x = np.random.default_rng(2).normal(size=(200, 32))
    q, s, zp = S.scale_search(x, method)
    assert relative(x, S.bf16((q - zp[:, None]) * s[:, None])) < 0.7


def test_header_of_nothing():
    assert len(E.rans_encode([b""])[0]) == 38
    assert E.rans_decode(E.rans_encode([b""])) == [b""]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=6), st.sampled_from([1, 64, 512]))
def test_coders_round_trip(sections, block):
    assert E.rans_decode(E.rans_encode(sections)) == sections
    assert E.tans_decode(E.tans_encode(sections, block=block)) == sections
    assert E.unpack_planar(E.pack_planar(sections)) == sections


def test_dictionary():
    r = random.Random(3)
    sections = [bytes(r.choices(range(256), weights=[1 / (1 + i) for i in range(256)], k=3000)) for _ in range(5)]
    tables = E.learn_dictionary(np.concatenate([E.block_histograms(s, 256) for s in sections]), 4)
    assert all(t.sum() == 4096 and t.min() >= 1 for t in tables)
    assert [t.tolist() for t in tables] == [t.tolist() for t in E.learn_dictionary(np.concatenate([E.block_histograms(s, 256) for s in sections]), 4)]
    blobs = E.tans_encode(sections, block=256, tables=tables, embed=False)
    assert E.tans_decode(blobs, tables) == sections
    assert all(isinstance(x, E.CorruptSection) for x in E.tans_decode(blobs))


def test_damage_never_hangs():
    r = random.Random(4)
    data = bytes(r.choices(range(256), weights=[1 / (1 + i) ** 2 for i in range(256)], k=2000))
    for _ in range(150):
        for make, undo in ((E.rans_encode, E.rans_decode), (lambda s: E.tans_encode(s, block=128), E.tans_decode)):
            b = bytearray(make([data])[0])
            for _ in range(3):
                b[r.randrange(len(b))] ^= 1 << r.randrange(8)
            undo([bytes(b)])
        cut = bytes(b[: r.randrange(len(b))])
        assert isinstance(E.tans_decode([cut])[0], E.CorruptSection)


def test_normalize():
    for counts in ([1] * 200 + [100_000] + [0] * 55, [1, 1, 1, 1000] + [0] * 252, [5] * 256):
        f = E.normalize(counts)
        assert f.sum() == 4096 and all((x > 0) == (c > 0) for x, c in zip(f, counts, strict=True))
    assert sorted(E.spread(E.normalize([3] * 256)).tolist()) == [s for s in range(256) for _ in range(16)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-128, 127), max_size=200))
def test_rice(values):
    v = np.array(values, np.int64)
    assert (E.rice_decode(E.rice_encode(v)) == v).all()


def natural(h, w, seed=42):
    rng = np.random.default_rng(seed)
    y = sum(np.roll(rng.integers(0, 256, (h, w)), k, 0) for k in range(3)) / 3
    t = np.sin(np.arange(w) / 9)[None] * 20
    return np.clip(np.stack([y * 0.3 + 90 + t, y * 0.3 + 80, y * 0.3 + 70 - t], -1), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("shape", [(1, 1), (5, 8), (17, 33), (64, 64)])
def test_wavelet_is_lossless(shape):
    x = np.random.default_rng(0).integers(-300, 300, (2, *shape))
    assert (W.idwt2(*W.dwt2(x)) == x).all()
    rgb = np.random.default_rng(1).integers(0, 256, (2, *shape, 3), dtype=np.uint8)
    assert (W.unrct(W.rct(rgb)) == rgb).all()


def test_codecs_and_bitstream():
    from tesserae.operators.images import psnr, xs_decode, xs_encode

    img = natural(40, 56)[None]
    assert psnr(img[0], W.static_decode(W.static_encode(img), 1.0, True, 40, 56)[0]) > 35
    sizes = []
    for mode in W.PRESETS:
        coded, half = W.adaptive_encode(img, mode)
        back = W.adaptive_decode(coded, half, 40, 56)
        arena = W.arena_pack(coded, half)
        assert (W.adaptive_decode(W.arena_unpack(arena, half, 40, 56), half, 40, 56) == back).all()
        for method in ("none", "rans", "tans"):
            assert (xs_decode(xs_encode(img, mode, method), half, 40, 56)[0] == back[0]).all()
        sizes.append(len(arena["u8"]) + len(arena["i8"]))
    assert sizes == sorted(sizes, reverse=True)


def test_gains():
    unit = W.synthesis_gain(1, "LH")
    for level, (side, corner) in W.GAIN.items():
        assert W.synthesis_gain(level, "HL") / unit == pytest.approx(side, abs=2e-3)
        assert W.synthesis_gain(level, "HH") / unit == pytest.approx(corner, abs=2e-3)
