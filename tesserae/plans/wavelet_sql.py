"""SQL of the two-dimensional wavelet queries over 16 x 16 tiles, stage by stage from the definitions of the transform."""

from __future__ import annotations

from tesserae.functions import wavelet as W

#: A row for each pixel comes in as px (page_id, tile, y, x, r, g, b).
OWN = "page_id, tile, c"


class Stages:
    """A chain of common table expressions."""

    def __init__(self, first: str) -> None:
        self.parts, self.n = [first], 0

    def add(self, body: str) -> str:
        self.n += 1
        self.parts.append(f"t{self.n} AS ({body})")
        return f"t{self.n}"

    def text(self, end: str) -> str:
        return f"WITH {', '.join(self.parts)} {end}"


def split(s: Stages, src: str, keys: str, at: str) -> str:
    """(keys, at, lo, hi) from (keys, at, v): one lifting step along `at`, which is halved."""
    w = f"WINDOW w AS (PARTITION BY {keys} ORDER BY {at})"
    e = s.add(f"SELECT {keys}, {at} // 2 AS {at}, max(v) FILTER ({at} % 2 = 0) AS ev, max(v) FILTER ({at} % 2 = 1) AS od FROM {src} GROUP BY {keys}, {at} // 2")
    a = s.add(f"SELECT *, od - ((ev + coalesce(lead(ev) OVER w, ev)) >> 1) AS hi FROM {e} {w}")
    return s.add(f"SELECT {keys}, {at}, ev + ((coalesce(lag(hi) OVER w, hi) + hi + 2) >> 2) AS lo, hi FROM {a} {w}")


def merge(s: Stages, src: str, keys: str, at: str) -> str:
    """(keys, at, v) from (keys, at, lo, hi)."""
    w = f"WINDOW w AS (PARTITION BY {keys} ORDER BY {at})"
    a = s.add(f"SELECT *, lo - ((coalesce(lag(hi) OVER w, hi) + hi + 2) >> 2) AS ev FROM {src} {w}")
    b = s.add(f"SELECT *, hi + ((ev + coalesce(lead(ev) OVER w, ev)) >> 1) AS od FROM {a} {w}")
    return s.add(f"SELECT {keys}, {at} * 2 AS {at}, ev AS v FROM {b} UNION ALL SELECT {keys}, {at} * 2 + 1, od FROM {b}")


def pyramid(s: Stages, half: bool) -> tuple[str, str]:
    """(coefficients (page_id, tile, c, level, b, y, x, v), coarse values (page_id, tile, c, v))."""
    yuv = s.add("SELECT page_id, tile, y, x, unnest([0, 1, 2]) AS c, unnest([(r + 2 * g + b) >> 2, b - g, r - g]) AS v FROM px")
    later = s.add(f"SELECT {OWN}, y // 2 AS y, x // 2 AS x, (CAST(sum(v) AS BIGINT) + 2) >> 2 AS v FROM {yuv} WHERE c > 0 GROUP BY {OWN}, y // 2, x // 2") if half else ""
    src, bands = s.add(f"SELECT * FROM {yuv} WHERE c = 0") if half else yuv, []
    for level in range(1, 5):
        if level == 2 and half:
            src = s.add(f"SELECT {OWN}, y, x, v FROM {src} UNION ALL SELECT {OWN}, y, x, v FROM {later}")
        h = split(s, src, f"{OWN}, y", "x")
        u = s.add(f"SELECT {OWN}, 0 AS g, y, x, lo AS v FROM {h} UNION ALL SELECT {OWN}, 1, y, x, hi FROM {h}")
        k = split(s, u, f"{OWN}, g, x", "y")
        bands.append(f"SELECT {OWN}, {level} AS level, CASE g WHEN 0 THEN 'LH' ELSE 'HL' END AS b, y, x, CASE g WHEN 0 THEN hi ELSE lo END AS v FROM {k} UNION ALL SELECT {OWN}, {level}, 'HH', y, x, hi FROM {k} WHERE g = 1")
        src = s.add(f"SELECT {OWN}, y, x, lo AS v FROM {k} WHERE g = 0")
    return s.add(" UNION ALL ".join(bands)), s.add(f"SELECT {OWN}, v FROM {src}")


def psnr(s: Stages, bands: str, low: str, half: bool) -> str:
    """(page_id, tile, psnr) of the image that the coefficients give."""
    src = s.add(f"SELECT {OWN}, 0 AS y, 0 AS x, v FROM {low}")
    done = None
    for level in (4, 3, 2, 1):
        k = s.add(
            f"SELECT a.page_id, a.tile, a.c, a.y, a.x, a.v AS ll, max(q.v) FILTER (q.b = 'LH') AS lh, max(q.v) FILTER (q.b = 'HL') AS hl, max(q.v) FILTER (q.b = 'HH') AS hh"
            f" FROM {src} a JOIN {bands} q ON q.level = {level} AND a.page_id = q.page_id AND a.tile = q.tile AND a.c = q.c AND a.y = q.y AND a.x = q.x GROUP BY a.page_id, a.tile, a.c, a.y, a.x, a.v"
        )
        u = s.add(f"SELECT {OWN}, 0 AS g, y, x, ll AS lo, lh AS hi FROM {k} UNION ALL SELECT {OWN}, 1, y, x, hl, hh FROM {k}")
        m = merge(s, u, f"{OWN}, g, x", "y")
        j = s.add(f"SELECT {OWN}, y, x, max(v) FILTER (g = 0) AS lo, max(v) FILTER (g = 1) AS hi FROM {m} GROUP BY {OWN}, y, x")
        src = merge(s, j, f"{OWN}, y", "x")
        if level == 2 and half:
            done, src = s.add(f"SELECT {OWN}, y * 2 + unnest([0, 0, 1, 1]) AS y, x * 2 + unnest([0, 1, 0, 1]) AS x, v FROM {src} WHERE c > 0"), s.add(f"SELECT * FROM {src} WHERE c = 0")
    every = s.add(f"SELECT {OWN}, y, x, v FROM {src}" + (f" UNION ALL SELECT {OWN}, y, x, v FROM {done}" if done else ""))
    p = s.add(f"SELECT page_id, tile, y, x, max(v) FILTER (c = 0) AS l, max(v) FILTER (c = 1) AS cb, max(v) FILTER (c = 2) AS cr FROM {every} GROUP BY page_id, tile, y, x")
    q = s.add(f"SELECT *, l - ((cb + cr) >> 2) AS g2 FROM {p}")
    clip = lambda v: f"greatest(0, least(255, {v}))"
    e = s.add(f"SELECT q.page_id, q.tile, sum((r - {clip('cr + g2')}) ** 2 + (g - {clip('g2')}) ** 2 + (b - {clip('cb + g2')}) ** 2) / CAST(768 AS DOUBLE) AS mse FROM {q} q JOIN px ON q.page_id = px.page_id AND q.tile = px.tile AND q.y = px.y AND q.x = px.x GROUP BY q.page_id, q.tile")
    return s.add(f"SELECT page_id, tile, round(CASE WHEN mse = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 20 * log10(CAST(255 AS DOUBLE) / sqrt(mse)) END, 6) AS psnr FROM {e}")


def by_plane(half: bool, value) -> str:
    """CASE over channel, level and band."""
    return "CASE " + " ".join(f"WHEN (c = 0) = {str(c == 0).lower()} AND level = {level} AND b = '{b}' THEN {value(c, level, b)}" for c, level, b in W.order(half) if c < 2) + " END"


def gone(half: bool) -> str:
    return f"(c > 0 AND b = 'HH' AND level = {2 if half else 1})"


def static(first: str) -> str:
    s = Stages(first)
    bands, low = pyramid(s, True)
    step = by_plane(True, lambda c, level, b: W.step(1.0, c, level, b))
    q = s.add(f"SELECT *, {step} AS st FROM {bands}")
    q = s.add(f"SELECT *, CASE WHEN {gone(True)} THEN 0 ELSE (sign(v) * (abs(v) // st) + 1152) % 256 - 128 END AS q FROM {q}")
    back = s.add(f"SELECT {OWN}, level, b, y, x, CAST(q * st + sign(q) * (st // 2) AS BIGINT) AS v FROM {q}")
    return s.text(f"SELECT page_id, CAST(tile AS INTEGER) AS tile, psnr FROM {psnr(s, back, low, True)}")


def coded(s: Stages, mode: str, bands: str, half: bool) -> str:
    """(page_id, tile, c, level, b, y, x, blk, quad, q, sc): codes that minimise error and rate block by block."""
    q_scale, lamb = W.PRESETS[mode]
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    base = by_plane(half, lambda c, level, b: d(float(W.step(q_scale, c, level, b))))
    gain = by_plane(half, lambda c, level, b: d(W.GAIN[level][b == "HH"] * (W.GAIN_CHROMA if c else W.GAIN_LUMA)))
    side = "(16 >> level)"
    x = s.add(f"SELECT *, (y * {side} + x) // 32 AS blk, (y * {side} + x) % 32 // 4 AS quad, CAST(v AS DOUBLE) AS xv, {base} AS base, {gain} AS gain FROM {bands} WHERE NOT {gone(half)}")
    m = s.add("SELECT unnest(range(0, 16)) AS i, unnest([" + ", ".join(d(float(v)) for v in W.CODEBOOK) + "]) AS m")
    t = s.add(f"SELECT x.*, i, base * m AS sc, greatest(-128, least(127, round_even(xv / (base * m), 0))) AS q FROM {x} x, {m}")
    blk = "page_id, tile, c, level, b, blk"
    u = s.add(f"SELECT {blk}, quad, i, any_value(gain) AS gain, sum((xv - q * sc) * (xv - q * sc)) AS e, count(*) FILTER (q <> 0) AS n FROM {t} GROUP BY {blk}, quad, i")
    r = s.add(f"SELECT {blk}, i, any_value(gain) AS gain, sum(e) AS e, sum(n) AS n, count(*) FILTER (n > 0) AS k FROM {u} GROUP BY {blk}, i")
    cost = f"gain * e + {d(lamb)} * CASE WHEN n = 0 THEN 1 WHEN k <= 5 THEN 14 + 4 * k + 8 * n ELSE 38 + 8 * n END"
    best = s.add(f"SELECT {blk}, arg_min(i, struct_pack(a := cost, z := i)) AS i FROM (SELECT *, {cost} AS cost FROM {r}) GROUP BY {blk}")
    f = s.add(f"SELECT x.*, z.i, base * m AS sc FROM {x} x JOIN {best} z USING ({blk}) JOIN {m} mm ON z.i = mm.i")
    f = s.add(f"SELECT *, greatest(-128, least(127, round_even(xv / sc, 0))) AS q0 FROM {f}")
    near = lambda k: f"greatest(-128, least(127, q0 + {k}))"
    price = lambda q: f"(gain * (xv - {q} * sc) * (xv - {q} * sc) + CASE WHEN {q} <> 0 THEN {d(8.0 * lamb)} ELSE 0 END)"
    f = s.add(f"SELECT *, {price(near(-1))} AS p0, {price(near(0))} AS p1, {price(near(1))} AS p2 FROM {f}")
    f = s.add(f"SELECT {OWN}, level, b, y, x, blk, quad, sc, CASE WHEN p0 <= p1 AND p0 <= p2 THEN {near(-1)} WHEN p1 <= p2 THEN {near(0)} ELSE {near(1)} END AS q FROM {f}")
    z = s.add(f"SELECT {OWN}, level, b, y, x, (y * {side} + x) // 32 AS blk, (y * {side} + x) % 32 // 4 AS quad, CAST(1 AS DOUBLE) AS sc, CAST(0 AS DOUBLE) AS q FROM {bands} WHERE {gone(half)}")
    return s.add(f"SELECT * FROM {f} UNION ALL SELECT * FROM {z}")


def adaptive(first: str) -> str:
    s, ends = Stages(first), []
    made = {half: pyramid(s, half) for half in (False, True)}
    for mode in W.PRESETS:
        half = mode not in W.FULL_CHROMA
        bands, low = made[half]
        q = coded(s, mode, bands, half)
        back = s.add(f"SELECT {OWN}, level, b, y, x, CAST(trunc(q * sc) AS BIGINT) AS v FROM {q}")
        p = psnr(s, back, low, half)
        ends.append(f"SELECT n.page_id, CAST(n.tile AS INTEGER) AS tile, '{mode}' AS mode, psnr, nonzero FROM (SELECT page_id, tile, CAST(count(*) FILTER (q <> 0) AS BIGINT) AS nonzero FROM {q} GROUP BY page_id, tile) n JOIN {p} p ON n.page_id = p.page_id AND n.tile = p.tile")
    return s.text(" UNION ALL ".join(ends))


def arena(first: str) -> str:
    s = Stages(first)
    bands, _ = pyramid(s, True)
    q = coded(s, "balanced", bands, True)
    plane = "page_id, tile, c, level, b"
    u = s.add(f"SELECT {plane}, blk, quad, count(*) FILTER (q <> 0) AS n FROM {q} GROUP BY {plane}, blk, quad")
    k = s.add(f"SELECT {plane}, blk, sum(n) AS n, count(*) FILTER (n > 0) AS quads FROM {u} GROUP BY {plane}, blk")
    p = s.add(f"SELECT {plane}, count(*) AS blocks, count(*) FILTER (n > 0) AS occ, count(*) FILTER (n > 0 AND quads <= 5) AS tree, count(*) FILTER (quads > 5) AS flat, coalesce(sum(quads) FILTER (quads <= 5), 0) AS nibs, sum(n) AS vals FROM {k} GROUP BY {plane}")
    u8 = "(blocks + 7) // 8 + (occ + 7) // 8 + 4 * flat + tree + (nibs + 1) // 2 + (blocks + 1) // 2"
    return s.text(f"SELECT page_id, CAST(tile AS INTEGER) AS tile, CAST(sum({u8}) AS BIGINT) AS u8, CAST(sum(vals) AS BIGINT) AS i8, CAST(6 AS BIGINT) AS ll4, CAST(count(*) AS BIGINT) AS planes FROM {p} GROUP BY page_id, tile")


def dct(first: str, matrix: list[list[float]], bf16) -> str:
    """8 x 8 cosine transform of luma, symmetric 8-bit codes in groups of 32 coefficients; the transform keeps squared errors."""
    s = Stages(first)
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    m = s.add("SELECT unnest(range(0, 64)) // 8 AS k, unnest(range(0, 64)) % 8 AS i, unnest([" + ", ".join(d(v) for row in matrix for v in row) + "]) AS m")
    p = s.add("SELECT page_id, tile, y // 8 AS bi, x // 8 AS bj, y % 8 AS y, x % 8 AS x, CAST((r + 2 * g + b) >> 2 AS DOUBLE) AS v FROM px")
    a = s.add(f"SELECT page_id, tile, bi, bj, k AS u, x, sum(m * v) AS v FROM {p} JOIN {m} ON i = y GROUP BY page_id, tile, bi, bj, k, x")
    c = s.add(f"SELECT page_id, tile, bi, bj, u, k AS w, round(sum(m * v), 6) AS v FROM {a} JOIN {m} ON i = x GROUP BY page_id, tile, bi, bj, u, k")
    g = s.add(f"SELECT page_id, tile, bi, bj, u // 4 AS h, {bf16(f'(greatest(max(abs(v)), {d(1e-8)}) / {d(127.0)})')} AS sc FROM {c} GROUP BY page_id, tile, bi, bj, u // 4")
    q = s.add(f"SELECT c.page_id, c.tile, v, sc, greatest({d(-128.0)}, least({d(127.0)}, round_even(v / sc, 0))) AS q FROM {c} c JOIN {g} g ON c.page_id = g.page_id AND c.tile = g.tile AND c.bi = g.bi AND c.bj = g.bj AND c.u // 4 = g.h")
    return s.text(f"SELECT page_id, CAST(tile AS INTEGER) AS tile, round(sqrt(avg((v - q * sc) * (v - q * sc))), 4) AS rmse, CAST(count(*) FILTER (q = 0) AS BIGINT) AS zeros FROM {q} GROUP BY page_id, tile")
