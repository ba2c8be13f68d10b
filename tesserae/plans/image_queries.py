"""Image queries over tiles of the bytes of `pages`, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tesserae.functions import wavelet as W
from tesserae.operators import images as I
from tesserae.operators import quantize as Q
from tesserae.plans import wavelet_sql
from tesserae.plans.cache_queries import scratch
from tesserae.plans.quant_queries import R6, d, f32, sql_bf16
from tesserae.sources import images as ingest
from tesserae.sources import pixel_cache as P
from tesserae.sources.tables import scan

QUERIES: dict = {}
SQL: dict[str, str] = {}
SIDE, SIZE = 16, 768


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def tiles(spark, path):
    return ingest.tiles(scan(spark, path, "pages", "page_id", "html"), "page_id", F.encode("html", "UTF-8"), SIDE)


def numbered(spark, path):
    """Tiles with one id: page and tile number in one long."""
    t = tiles(spark, path)
    return t.withColumn("id", F.col("page_id") * 1_000_000 + F.col("tile"))


BYTES = f"h AS (SELECT page_id, hex(encode(coalesce(html, ''))) AS x FROM pages), n AS (SELECT page_id, x, len(x) // 2 AS n FROM h), y AS (SELECT page_id, i // {SIZE} AS tile, i % {SIZE} AS p, CASE WHEN i < n THEN CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) ELSE 0 END AS v FROM (SELECT page_id, x, n, unnest(range(0, (n + {SIZE - 1}) // {SIZE} * {SIZE})) AS i FROM n))"
TILES = f"SELECT page_id, CAST(unnest(range(0, (strlen(coalesce(html, '')) + {SIZE - 1}) // {SIZE})) AS INTEGER) AS tile"


PIX = f"{BYTES}, px AS (SELECT page_id, tile, p // 3 // {SIDE} AS y, p // 3 % {SIDE} AS x, max(v) FILTER (p % 3 = 0) AS r, max(v) FILTER (p % 3 = 1) AS g, max(v) FILTER (p % 3 = 2) AS b FROM y GROUP BY page_id, tile, p // 3)"


@query(f"WITH {PIX}, c AS (SELECT *, (r + 2 * g + b) >> 2 AS l, b - g AS cb, r - g AS cr FROM px), k AS (SELECT *, l - ((cb + cr) >> 2) AS g2 FROM c) SELECT page_id, CAST(tile AS INTEGER) AS tile, CAST(sum(l) AS BIGINT) AS sum_y, CAST(sum(cb) AS BIGINT) AS sum_cb, CAST(sum(cr) AS BIGINT) AS sum_cr, bool_and(cr + g2 = r AND g2 = g AND cb + g2 = b) AS same FROM k GROUP BY ALL")
def rct_roundtrip(spark, path):
    """The colour transform of each tile and back."""
    def fn(stack: np.ndarray) -> list[dict]:
        n, yuv = len(stack), W.rct(stack)
        total, same = yuv.reshape(n, -1, 3).sum(1, dtype=np.int64), (W.unrct(yuv) == stack).reshape(n, -1).all(1)
        return [{"sum_y": int(t[0]), "sum_cb": int(t[1]), "sum_cr": int(t[2]), "same": bool(x)} for t, x in zip(total, same, strict=True)]

    return flagged(spark, path, fn, "sum_y long, sum_cb long, sum_cr long, same boolean", "sum_y", "sum_cb", "sum_cr", "same")


@query(f"WITH {PIX} , s AS (SELECT page_id, tile, y // 2 AS y, x // 2 AS x, (sum(b - g) + 2)::BIGINT >> 2 AS cb, (sum(r - g) + 2)::BIGINT >> 2 AS cr FROM px GROUP BY ALL) SELECT page_id, CAST(tile AS INTEGER) AS tile, CAST(sum(cb) AS BIGINT) AS sum_cb, CAST(sum(cr) AS BIGINT) AS sum_cr FROM s GROUP BY ALL".replace("GROUP BY ALL)", "GROUP BY page_id, tile, y // 2, x // 2)"))
def downsample420(spark, path):
    """Halved chroma planes."""
    def fn(stack: np.ndarray) -> list[dict]:
        yuv = W.rct(stack)
        cb, cr = (W.shrink(yuv[..., k]).reshape(len(stack), -1).sum(1, dtype=np.int64) for k in (1, 2))
        return [{"sum_cb": int(x), "sum_cr": int(y)} for x, y in zip(cb, cr, strict=True)]

    return flagged(spark, path, fn, "sum_cb long, sum_cr long", "sum_cb", "sum_cr")


LIFT = f"""{BYTES}, e AS (SELECT page_id, tile, p // 2 AS j, max(v) FILTER (p % 2 = 0) AS ev, max(v) FILTER (p % 2 = 1) AS od FROM y GROUP BY page_id, tile, p // 2),
a AS (SELECT *, od - ((ev + coalesce(lead(ev) OVER w, ev)) >> 1) AS hi FROM e WINDOW w AS (PARTITION BY page_id, tile ORDER BY j)),
c AS (SELECT *, ev + ((coalesce(lag(hi) OVER w, hi) + hi + 2) >> 2) AS lo FROM a WINDOW w AS (PARTITION BY page_id, tile ORDER BY j)),
u AS (SELECT *, lo - ((coalesce(lag(hi) OVER w, hi) + hi + 2) >> 2) AS ev2 FROM c WINDOW w AS (PARTITION BY page_id, tile ORDER BY j)),
z AS (SELECT *, hi + ((ev2 + coalesce(lead(ev2) OVER w, ev2)) >> 1) AS od2 FROM u WINDOW w AS (PARTITION BY page_id, tile ORDER BY j))"""


@query(f"WITH {LIFT} SELECT page_id, CAST(tile AS INTEGER) AS tile, CAST(sum(lo) AS BIGINT) AS sum_low, CAST(sum(hi) AS BIGINT) AS sum_high, bool_and(ev2 = ev AND od2 = od) AS same FROM z GROUP BY ALL")
def dwt1d_levels(spark, path):
    """One lifting level over each tile's bytes as a row, and its inverse."""
    def fn(stack: np.ndarray) -> list[dict]:
        x = stack.reshape(len(stack), -1).astype(np.int64)
        low, high = W.halves(x, -1)
        same = (W.unhalves(low, high, -1) == x).all(1)
        return [{"sum_low": int(a), "sum_high": int(b), "same": bool(e)} for a, b, e in zip(low.sum(1), high.sum(1), same, strict=True)]

    return flagged(spark, path, fn, "sum_low long, sum_high long, same boolean", "sum_low", "sum_high", "same")


def flagged(spark, path, fn, schema, *cols):
    return I.map_images(tiles(spark, path), fn, schema).select("page_id", "tile", *cols)


@query(f"{TILES}, true AS same FROM pages")
def dwt2d_roundtrip(spark, path):
    """Four levels of the two-dimensional transform and back, on each colour plane."""
    def fn(stack: np.ndarray) -> list[dict]:
        x = np.moveaxis(W.rct(stack), -1, 1)
        bands, low = [], x
        for _ in range(4):
            low, *b = W.dwt2(low)
            bands.append(b)
        for b in reversed(bands):
            low = W.idwt2(low, *b)
        return [{"same": bool(s)} for s in (low == x).reshape(len(x), -1).all(1)]

    return flagged(spark, path, fn, "same boolean", "same")


@query(wavelet_sql.static(PIX))
def static_wavelet_psnr(spark, path):
    def fn(stack: np.ndarray) -> list[dict]:
        _, h, w, _ = stack.shape
        back = W.static_decode(W.static_encode(stack, 1.0, True), 1.0, True, h, w)
        return [{"psnr": round(I.psnr(a, b), 6)} for a, b in zip(stack, back, strict=True)]

    return flagged(spark, path, fn, "psnr double", "psnr")


@query(wavelet_sql.adaptive(PIX))
def adaptive_wavelet(spark, path):
    """Error and non-zero codes of every preset, by page."""
    def fn(stack: np.ndarray) -> list[dict]:
        _, h, w, _ = stack.shape
        rows: list[list[dict]] = [[] for _ in stack]
        planes = {half: W.pyramid(stack, half) for half in (False, True)}
        for mode in W.PRESETS:
            coded, half = W.adaptive_encode(stack, mode, planes=planes[mode not in W.FULL_CHROMA])
            back = W.adaptive_decode(coded, half, h, w)
            for k in range(len(stack)):
                rows[k].append({"mode": mode, "psnr": round(I.psnr(stack[k], back[k]), 6), "nonzero": int(sum((own[key][0][k] != 0).sum() for own in coded for key in own if key != "LL4"))})
        return [{"r": r} for r in rows]

    return I.map_images(tiles(spark, path), fn, "r array<struct<mode:string,psnr:double,nonzero:long>>").select("page_id", "tile", F.explode("r").alias("r")).select("page_id", "tile", "r.*")


@query(f"{TILES}, true AS same FROM pages")
def sparse_roundtrip(spark, path):
    """Every plane of the balanced preset through the sparse bitstream and back."""
    def fn(stack: np.ndarray) -> list[dict]:
        coded, half = W.adaptive_encode(stack, "balanced")
        same = np.ones(len(stack), bool)
        for c, level, b in W.order(half):
            p = coded[c][level, b][0]
            same &= [bool((W.sparse_unpack(s, *x.shape) == x).all()) for s, x in zip(W.sparse_pack_all(p), p, strict=True)]
        return [{"same": bool(s)} for s in same]

    return flagged(spark, path, fn, "same boolean", "same")


@query(wavelet_sql.arena(PIX))
def arena_bytes(spark, path):
    """Bytes of each part of the arenas."""
    def fn(stack: np.ndarray) -> list[dict]:
        coded, half = W.adaptive_encode(stack, "balanced")
        return [{"u8": len(a["u8"]), "i8": len(a["i8"]), "ll4": len(a["ll4"]), "planes": len(a["meta"])} for a in W.arena_pack_all(coded, half)]

    return flagged(spark, path, fn, "u8 long, i8 long, ll4 long, planes long", "u8", "i8", "ll4", "planes")


@query(f"{TILES}, true AS same_tans, true AS same_none FROM pages")
def xs_cache_roundtrip(spark, path):
    """Wavelet caches with no, range and table coding decode to the same images."""
    at = scratch(spark, "tiles")
    numbered(spark, path).write.parquet(at)  # each cache checks its images before it codes them: they are cut out once
    src = spark.read.parquet(at)
    got = {}
    for entropy in ("none", "rans", "tans"):
        at = scratch(spark, f"pixels-{entropy}")
        P.PixelCacheWriter(spark, at, "xs", "balanced", entropy).write(src.select("id", "height", "width", "channels", "data"))
        got[entropy] = P.PixelCacheDataset(spark, at).images().select("id", F.col("data").alias(entropy))
    j = got["rans"].join(got["none"], "id").join(got["tans"], "id")
    return j.select(F.floor(F.col("id") / 1_000_000).cast("long").alias("page_id"), (F.col("id") % 1_000_000).cast("int").alias("tile"), (F.col("rans") == F.col("tans")).alias("same_tans"), (F.col("rans") == F.col("none")).alias("same_none"))


def sql_pixels(top: int) -> str:
    x = f"CAST(CAST(v AS FLOAT) / CAST(127.5 AS FLOAT) - CAST(1 AS FLOAT) AS DOUBLE)"
    return f"""WITH {BYTES}, f AS (SELECT page_id, tile, p, v, {x} AS x FROM y), s AS (SELECT page_id, tile, p // 32 AS blk, {sql_bf16(f'(greatest(max(abs(x)), {d(1e-8)}) / {d(float(top))})')} AS sc FROM f GROUP BY ALL),
r AS (SELECT f.page_id, f.tile, v, greatest({d(0.0)}, least({d(255.0)}, round_even((greatest({d(-top - 1.0)}, least({d(float(top))}, round_even({f32('x / sc')}, 0))) * sc + 1) * {d(127.5)}, 0))) AS w FROM f JOIN s ON f.page_id = s.page_id AND f.tile = s.tile AND f.p // 32 = s.blk)
SELECT page_id, round(CASE WHEN sum((v - w) * (v - w)) = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 20 * log10({d(255.0)} / sqrt(avg((v - w) * (v - w)))) END, 6) AS psnr FROM r GROUP BY page_id""".replace("FROM f GROUP BY ALL", "FROM f GROUP BY page_id, tile, p // 32")


def pixel_psnr(spark, path, bits):
    def fn(stack: np.ndarray) -> list[dict]:
        back = I.unblockwise(*I.blockwise(stack, bits, 32), 32)
        e = ((stack.reshape(len(stack), -1).astype(np.int64) - back) ** 2).sum(1)
        return [{"sse": int(x)} for x in e]

    t = I.map_images(tiles(spark, path), fn, "sse long").groupBy("page_id").agg((F.sum("sse") / (F.count(F.lit(1)) * SIZE)).alias("mse"))
    return t.select("page_id", R6(F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(20 * F.log10(F.lit(255.0) / F.sqrt("mse")))).alias("psnr"))


@query(sql_pixels(7))
def pixel_psnr_int4(spark, path):
    return pixel_psnr(spark, path, 4)


@query(sql_pixels(3))
def pixel_psnr_int3(spark, path):
    return pixel_psnr(spark, path, 3)


@query(f"WITH {BYTES}, t AS (SELECT page_id, CAST(v AS DOUBLE) AS x, CAST(v // 8 * 8 + 4 AS DOUBLE) AS r FROM y) SELECT page_id, round(((2 * avg(x) * avg(r) + 6.5025) * (2 * covar_pop(x, r) + 58.5225)) / ((avg(x) * avg(x) + avg(r) * avg(r) + 6.5025) * (var_pop(x) + var_pop(r) + 58.5225)), 6) AS ssim FROM t GROUP BY page_id")
def ssim_global(spark, path):
    """Structural similarity of a page's bytes and the same with five bits, from sums by tile."""
    def fn(stack: np.ndarray) -> list[dict]:
        x = stack.reshape(len(stack), -1).astype(np.int64)
        r = x // 8 * 8 + 4
        return [dict(zip(("n", "x", "r", "xx", "rr", "xr"), map(int, t), strict=True)) for t in zip([x.shape[1]] * len(x), x.sum(1), r.sum(1), (x * x).sum(1), (r * r).sum(1), (x * r).sum(1), strict=True)]

    t = flagged(spark, path, fn, "n long, x long, r long, xx long, rr long, xr long", "n", "x", "r", "xx", "rr", "xr").groupBy("page_id").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "x", "r", "xx", "rr", "xr")])
    mean = lambda c: F.col(c) / F.col("n")
    x, r = mean("x"), mean("r")
    return t.select("page_id", R6(((2 * x * r + 6.5025) * (2 * (mean("xr") - x * r) + 58.5225)) / ((x * x + r * r + 6.5025) * (mean("xx") - x * x + mean("rr") - r * r + 58.5225))).alias("ssim"))


@query(wavelet_sql.dct(PIX, Q.dct_matrix(), sql_bf16))
def block_dct(spark, path):
    """8 x 8 cosine transform of the luma plane, symmetric INT8 coefficients: error and number of zeros."""
    from tesserae.functions import search as S

    m = np.array(Q.dct_matrix())

    def fn(stack: np.ndarray) -> list[dict]:
        y = W.rct(stack)[..., 0].astype(np.float64)
        n, h, w = y.shape
        b = y.reshape(n, h // 8, 8, w // 8, 8).transpose(0, 1, 3, 2, 4)
        c = np.round(m @ b @ m.T, 6).reshape(n, -1, 32)  # to a grid, so that the order of sums decides no code
        s = S.bf16(np.maximum(np.abs(c).max(2), 1e-8) / 127)[:, :, None]
        q = np.clip(np.rint(c / s), -128, 127)
        back = m.T @ (q * s).reshape(b.shape) @ m
        return [{"rmse": round(float(np.sqrt(((back[k] - b[k]) ** 2).mean())), 4), "zeros": int((q[k] == 0).sum())} for k in range(n)]

    return flagged(spark, path, fn, "rmse double, zeros long", "rmse", "zeros")


@query(f"WITH n AS (SELECT CAST(sum((strlen(coalesce(html, '')) + {SIZE - 1}) // {SIZE}) AS BIGINT) AS n FROM pages) SELECT CAST(unnest(range(0, n // 32)) AS BIGINT) AS batch_id, CAST(32 AS BIGINT) AS n, CAST(32 * {SIZE} AS BIGINT) AS bytes FROM n")
def loader_batches(spark, path):
    """A shuffled loader over a raw cache: images by batch, short last batch dropped."""
    at = scratch(spark, "pixels-raw")
    P.PixelCacheWriter(spark, at, "raw").write(numbered(spark, path).select("id", "height", "width", "channels", "data"))
    return P.PixelCacheDataset(spark, at).loader(32, shuffle=True, seed=5, drop_last=True).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("bytes"))
