"""Quantization and metric queries over `embeddings`, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import numerics as N
from tesserae.functions import search as S
from tesserae.operators import metrics as M
from tesserae.operators import quantize as Q
from tesserae.operators.ranking import running
from tesserae.sources.tables import scan

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def emb(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "embeddings", "vec_id", "label", "embedding")


# SQL pieces. Constants are cast, as decimal literals would divide as decimals.
def d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def sql_grid(x: str, bits: int, least: int) -> str:
    ulp = f"pow({d(2.0)}, greatest(floor(log2(abs({x}))), {least}) - {bits - 1})"
    return f"(CASE WHEN {x} = 0 THEN {d(0.0)} ELSE round_even(({x}) / {ulp}, 0) * {ulp} END)"


def sql_bf16(x: str) -> str:
    return sql_grid(x, 8, -126)


def f32(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def clamp(x: str, low: int, high: int) -> str:
    return f"greatest({d(float(low))}, least({d(float(high))}, {x}))"


def sql_blocks(group: int) -> str:
    return f"b AS (SELECT vec_id, label, k AS block, CAST(list_slice(embedding, k * {group} + 1, k * {group} + {group}) AS DOUBLE[]) AS x FROM (SELECT *, unnest(range(0, CAST(ceil(len(embedding) / {d(float(group))}) AS BIGINT))) AS k FROM embeddings))"


def sql_sym(group: int = 32, top: int = 127, scale=sql_bf16) -> str:
    """CTEs b (blocks), s (with scale sc), c (with codes q)."""
    raw = f32(f"greatest(list_max([abs(v) for v in x]), {d(1e-8)}) / {d(float(top))}")
    return f"""{sql_blocks(group)}, s0 AS (SELECT *, {raw} AS raw FROM b), s AS (SELECT *, {scale('raw')} AS sc FROM s0),
c AS (SELECT *, [{clamp(f"round_even({f32('v / sc')}, 0)", -top - 1, top)} for v in x] AS q FROM s)"""


def sql_values(codes: str, rec: str = sql_bf16("q * sc")) -> str:
    """CTE v (vec_id, label, block, x, r): a row per value of CTE c, with its decoding."""
    return f"{codes}, v0 AS (SELECT vec_id, label, block, sc, unnest(x) AS x, unnest(q) AS q, unnest(range(0, len(x))) AS i FROM c), v AS (SELECT vec_id, label, block, i, x, {rec} AS r FROM v0)"


def sym(spark: SparkSession, path: str, group: int = 32, mode: str = "sym") -> DataFrame:
    return Q.encode(emb(spark, path), "embedding", mode, group)


def value_rows(coded: DataFrame, rec=None, *keep: str) -> DataFrame:
    """(label, vec_id, pos, x, r) by zipping inside the row; only this much is exploded."""
    rec = Q.decode(F.col("code")) if rec is None else rec
    z = F.arrays_zip(Q.values("embedding").alias("x"), rec.alias("r"))
    out = coded.select("vec_id", "label", *keep, F.posexplode(z).alias("pos", "z"))
    return out.select("vec_id", "label", *keep, "pos", F.col("z.x").alias("x"), F.col("z.r").alias("r"))


def blocks_of(coded: DataFrame) -> DataFrame:
    return coded.select("vec_id", "label", F.explode("code").alias("b")).select("vec_id", "label", "b.*")


R6 = lambda c: F.round(c, 6)
REL = f"round({d(100.0)} * sqrt(sum((x - r) * (x - r))) / sqrt(sum(x * x)), 6)"


@query(f"WITH {sql_sym()} SELECT vec_id, CAST(sum(list_sum(q)) AS BIGINT) AS sum_q, CAST(sum(list_sum([abs(z) for z in q])) AS BIGINT) AS sum_abs_q, CAST(min(list_min(q)) AS BIGINT) AS min_q, CAST(max(list_max(q)) AS BIGINT) AS max_q FROM c GROUP BY vec_id")
def sym_int8_codes(spark, path):
    q = F.flatten(F.transform("code", lambda b: b["q"]))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v).cast("long")
    return sym(spark, path).select("vec_id", total(q).alias("sum_q"), total(F.transform(q, lambda v: F.abs(v))).alias("sum_abs_q"), F.array_min(q).cast("long").alias("min_q"), F.array_max(q).cast("long").alias("max_q"))


@query(f"WITH {sql_sym()} SELECT vec_id, CAST(block AS BIGINT) AS block, sc AS scale FROM s")
def sym_int8_scales(spark, path):
    return blocks_of(sym(spark, path)).select("vec_id", F.col("block").cast("long").alias("block"), "scale")


@query(f"WITH {sql_values(sql_sym())} SELECT vec_id, CAST(count(*) AS BIGINT) AS n, round(sum(r), 6) AS sum_r, round(sum((x - r) * (x - r)), 9) AS sse FROM v GROUP BY vec_id")
def sym_int8_decode(spark, path):
    x, r = Q.values("embedding"), Q.decode(F.col("code"))
    e = F.zip_with(x, r, lambda a, b: (a - b) * (a - b))
    return sym(spark, path).select("vec_id", F.size(r).cast("long").alias("n"), R6(N.total(r)).alias("sum_r"), F.round(N.total(e), 9).alias("sse"))


@query(f"WITH {sql_values(sql_sym())} SELECT label, CAST(count(*) AS BIGINT) AS n, {REL} AS rel_rmse, CAST(count(*) + 2 * count(DISTINCT (vec_id, block)) AS BIGINT) AS stored_bytes FROM v GROUP BY label")
def sym_rmse_by_label(spark, path):
    """Error and stored bytes of symmetric INT8 by label. Each row reduces to three sums before the shuffle."""
    x, r = Q.values("embedding"), Q.decode(F.col("code"))
    rows = sym(spark, path).select("label", F.size("embedding").alias("n"), F.size("code").alias("nb"), N.total(F.zip_with(x, r, lambda a, b: (a - b) * (a - b))).alias("sse"), N.total(F.transform(x, lambda a: a * a)).alias("energy"))
    return rows.groupBy("label").agg(F.sum("n").alias("n"), R6(100.0 * F.sqrt(F.sum("sse")) / F.sqrt(F.sum("energy"))).alias("rel_rmse"), F.sum(F.col("n") + 2 * F.col("nb")).alias("stored_bytes"))


SWEEP = (8, 16, 32, 64)



@query(" UNION ALL ".join(f"SELECT * FROM (WITH {sql_values(sql_sym(g))} SELECT CAST({g} AS INTEGER) AS group_size, {REL} AS rel_rmse FROM v)" for g in SWEEP))
def group_size_sweep(spark, path):
    return tried(spark, path, [("sym", g) for g in SWEEP]).select("group_size", "rel_rmse")


def tried(spark, path, settings):
    """Q.errors with the relative error: all settings in one scan."""
    rows = Q.errors(emb(spark, path), "embedding", settings)
    return rows.select("k", "mode", "group_size", R6(100.0 * F.sqrt("sse") / F.sqrt("energy")).alias("rel_rmse"))


def sql_cand(n: int, low: float, high: float) -> str:
    return f"{d(low)} + ({d(high)} - {d(low)}) * i / {d(float(n - 1))}"


def sql_adaptive() -> str:
    return f"""WITH {sql_blocks(32)}, s AS (SELECT *, greatest(list_max([abs(v) for v in x]), {d(1e-8)}) / {d(127.0)} AS s0 FROM b),
cand AS (SELECT *, s0 * ({sql_cand(31, 0.90, 1.05)}) AS sc FROM (SELECT *, unnest(range(0, 31)) AS i FROM s)),
e AS (SELECT *, list_sum([(v - {clamp("round_even(v / sc, 0)", -128, 127)} * sc) * (v - {clamp("round_even(v / sc, 0)", -128, 127)} * sc) for v in x]) AS err FROM cand),
w AS (SELECT *, row_number() OVER (PARTITION BY vec_id, block ORDER BY err, i) AS rn FROM e),
p AS (SELECT *, {sql_bf16('sc')} AS st FROM w WHERE rn = 1)
SELECT vec_id, CAST(block AS BIGINT) AS block, CAST(i AS BIGINT) AS winner, st AS scale, round(err, 9) AS err, CAST(list_sum([{clamp("round_even(v / st, 0)", -128, 127)} for v in x]) AS BIGINT) AS sum_q FROM p"""


def search_rows(spark, path, mode):
    sum_q = F.aggregate("q", F.lit(0), lambda a, v: a + v).cast("long")
    return blocks_of(sym(spark, path, 32, mode)).select("vec_id", F.col("block").cast("long").alias("block"), F.col("winner").cast("long").alias("winner"), "scale", F.round("error", 9).alias("err"), sum_q.alias("sum_q"), F.col("zp").cast("long").alias("zp"))


@query(sql_adaptive())
def adaptive_int8(spark, path):
    return search_rows(spark, path, "adaptive").drop("zp")


def sql_amo(mode: str) -> str:
    n, low, high = S.PRESETS[mode]
    q = clamp("round_even(v / sc + zp, 0)", 0, 255)
    return f"""WITH {sql_blocks(32)}, s AS (SELECT *, list_min(x) AS lo, greatest(list_max(x) - list_min(x), {d(1e-8)}) / {d(255.0)} AS s0 FROM b),
cand AS (SELECT *, s0 * ({sql_cand(n, low, high)}) AS sc FROM (SELECT *, unnest(range(0, {n})) AS i FROM s)),
z AS (SELECT *, {clamp("round_even(-lo / sc, 0)", 0, 255)} AS zp FROM cand),
e AS (SELECT *, list_sum([(v - ({q} - zp) * sc) * (v - ({q} - zp) * sc) for v in x]) AS err FROM z),
w AS (SELECT *, row_number() OVER (PARTITION BY vec_id, block ORDER BY err, i) AS rn FROM e)
SELECT vec_id, CAST(block AS BIGINT) AS block, CAST(i AS BIGINT) AS winner, {sql_bf16('sc')} AS scale, round(err, 9) AS err, CAST(list_sum([{q} for v in x]) AS BIGINT) AS sum_q, CAST(zp AS BIGINT) AS zp FROM w WHERE rn = 1"""


def add_amo(mode: str) -> None:
    def run(spark, path):
        return search_rows(spark, path, f"amo_{mode}")

    run.__name__ = f"amo_{mode}"
    query(sql_amo(mode))(run)


for _mode in ("fast", "balanced", "accurate", "max"):
    add_amo(_mode)

# bits of a positive bfloat16 grid value: 128 * (exponent + 127) + mantissa - 128, and back
BITS = lambda x: f"CAST((floor(log2({x})) + 126) * 128 + ({x}) / pow({d(2.0)}, floor(log2({x})) - 7) AS BIGINT)"
FROM_BITS = "((128 + bits % 128) * pow(CAST(2.0 AS DOUBLE), (bits // 128) - 134))"
TRY = lambda k: f"least(greatest(round_even(v / sc + zp, 0) + {k}, {d(0.0)}), {d(255.0)})"
ERR = lambda k: f"pow(v - {sql_bf16('((' + TRY(k) + ' - zp) * sc)')}, 2)"


@query(f"""WITH {sql_blocks(32)}, s AS (SELECT *, least(list_min(x), 0) AS lo, greatest(greatest(list_max(x), 0) / {d(255.0)} - least(list_min(x), 0) / {d(255.0)}, {d(1e-8)} / {d(255.0)}) AS s0 FROM b),
g AS (SELECT *, {sql_bf16(f32(f's0 * {d(0.85)}'))} AS a, {sql_bf16(f32(f's0 * {d(1.10)}'))} AS z FROM s),
h AS (SELECT *, {BITS('a')} AS first, {BITS('z')} AS last FROM g),
k AS (SELECT *, {FROM_BITS} AS sc FROM (SELECT *, unnest(range(first, least(last, first + 63) + 1)) AS bits FROM h)),
z AS (SELECT *, {clamp("round_even(-lo / sc, 0)", 0, 255)} AS zp FROM k),
e AS (SELECT *, list_sum([least({ERR(0)}, {ERR(-1)}, {ERR(1)}) for v in x]) AS err FROM z),
w AS (SELECT *, row_number() OVER (PARTITION BY vec_id, block ORDER BY err, bits) AS rn FROM e)
SELECT vec_id, CAST(block AS BIGINT) AS block, bits AS scale_bits, CAST(zp AS BIGINT) AS zp, round(err, 9) AS err FROM w WHERE rn = 1""")
def amo_quality(spark, path):
    return search_rows(spark, path, "amo_quality").select("vec_id", "block", F.col("winner").alias("scale_bits"), "zp", "err")


def sql_int(top: int) -> str:
    return f"WITH {sql_values(sql_sym(32, top))} SELECT vec_id, CAST(sum(round_even(q, 0)) AS BIGINT) AS sum_q, CAST(min(q) AS BIGINT) AS min_q, CAST(max(q) AS BIGINT) AS max_q, round(sum((x - r) * (x - r)), 8) AS sse FROM (SELECT v0.vec_id, v0.q, v0.x, {sql_bf16('v0.q * v0.sc')} AS r FROM v0) GROUP BY vec_id"


def int_rows(spark, path, mode):
    q = F.flatten(F.transform("code", lambda b: b["q"]))
    x, r = Q.values("embedding"), Q.decode(F.col("code"))
    return sym(spark, path, 32, mode).select(
        "vec_id", F.aggregate(q, F.lit(0), lambda a, v: a + v).cast("long").alias("sum_q"), F.array_min(q).cast("long").alias("min_q"), F.array_max(q).cast("long").alias("max_q"),
        F.round(N.total(F.zip_with(x, r, lambda a, b: (a - b) * (a - b))), 8).alias("sse"))


@query(sql_int(7))
def int4_codes(spark, path):
    return int_rows(spark, path, "int4")


@query(sql_int(3))
def int3_codes(spark, path):
    return int_rows(spark, path, "int3")


def packed(spark, path, mode, pack):
    q = F.flatten(F.transform("code", lambda b: b["q"]))
    return sym(spark, path, 32, mode).select("vec_id", F.explode(F.transform(pack(q), lambda v, i: F.struct(i.alias("i"), v.alias("v")))).alias("p")).select("vec_id", F.col("p.i").cast("long").alias("pos"), F.col("p.v").cast("long").alias("byte"))


FLATQ = "f AS (SELECT vec_id, block * 32 + i AS p, CAST(q AS BIGINT) AS q FROM v0)"


@query(f"WITH {sql_values(sql_sym(32, 7))}, {FLATQ} SELECT vec_id, CAST(p // 2 AS BIGINT) AS pos, CAST(sum((q & 15) << CAST(4 * (p % 2) AS INTEGER)) AS BIGINT) AS byte FROM f GROUP BY vec_id, p // 2")
def int4_pack(spark, path):
    return packed(spark, path, "int4", N.pack_nibbles)


@query(f"""WITH {sql_values(sql_sym(32, 3))}, {FLATQ}, bits AS (SELECT vec_id, p * 3 + j AS bit, ((q + 4) >> (2 - j)) & 1 AS on_ FROM (SELECT *, CAST(unnest(range(0, 3)) AS INTEGER) AS j FROM f))
SELECT vec_id, CAST(bit // 8 AS BIGINT) AS pos, CAST(sum(on_ << CAST(7 - bit % 8 AS INTEGER)) AS BIGINT) AS byte FROM bits GROUP BY vec_id, bit // 8""")
def int3_pack(spark, path):
    return packed(spark, path, "int3", N.pack_triples)


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, true AS same4, true AS same3 FROM embeddings")
def pack_roundtrip(spark, path):
    four = F.flatten(F.transform("code", lambda b: b["q"]))
    df = Q.encode(Q.encode(emb(spark, path), "embedding", "int4"), "embedding", "int3", out="code3")
    df = df.select("vec_id", "embedding", four.alias("q4"), F.flatten(F.transform("code3", lambda b: b["q"])).alias("q3"))
    df = df.select("*", N.pack_nibbles(F.col("q4")).alias("p4"), N.pack_triples(F.col("q3")).alias("p3"))
    return df.select("vec_id", F.size("embedding").cast("long").alias("n"), (N.unpack_nibbles(F.col("p4"), F.size("q4")) == F.col("q4")).alias("same4"), (N.unpack_triples(F.col("p3"), F.size("q3")) == F.col("q3")).alias("same3"))


@query(f"""WITH {sql_blocks(32)}, s AS (SELECT *, list_min(x) AS lo, {sql_bf16(f32(f'greatest(list_max(x) - list_min(x), {d(1e-8)}) / {d(255.0)}'))} AS sc FROM b),
z AS (SELECT *, {clamp("round_even(" + f32('-lo / sc') + ", 0)", 0, 255)} AS zp FROM s)
SELECT vec_id, CAST(block AS BIGINT) AS block, sc AS scale, CAST(zp AS BIGINT) AS zp, CAST(list_sum([{clamp("round_even(" + f32('v / sc') + " + zp, 0)", 0, 255)} for v in x]) AS BIGINT) AS sum_q FROM z""")
def asym_minmax(spark, path):
    b = emb(spark, path).select("vec_id", F.posexplode(Q.affine_minmax(Q.values("embedding"), 32)).alias("block", "b"))
    return b.select("vec_id", F.col("block").cast("long").alias("block"), F.col("b.scale").alias("scale"), F.col("b.zp").cast("long").alias("zp"), N.total(F.col("b.q")).cast("long").alias("sum_q"))


@query(f"WITH {sql_values(sql_sym(32), 'q * sc')} SELECT label, round(sum((x - r) * (x - r)), 6) AS sse, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY label")
def token_aligned(spark, path):
    """Blocks that never cross a vector's end, decoded without rounding to the 16-bit grid."""
    rec = N.decoded(F.col("code"), lambda c: c)
    return value_rows(sym(spark, path), rec).groupBy("label").agg(R6(M.sse()).alias("sse"), F.count(F.lit(1)).alias("n"))


E4M3 = lambda x: sql_grid(clamp(f32(x), -448, 448), 4, -6)


@query(f"""WITH {sql_blocks(32)}, s AS (SELECT *, {sql_bf16(f32(f'greatest(list_max([abs(v) for v in x]), {d(1e-8)}) / {d(448.0)}'))} AS sc FROM b),
v0 AS (SELECT label, sc, unnest(x) AS x FROM s), v AS (SELECT label, x, {E4M3('x / sc')} * sc AS r FROM v0) SELECT label, {REL} AS rel_rmse FROM v GROUP BY label""")
def mxfp8(spark, path):
    rec = Q.minifloat_blocks(Q.values("embedding"), 32)
    return value_rows(emb(spark, path), rec).groupBy("label").agg(R6(M.rel_rmse()).alias("rel_rmse"))


@query(f"""WITH f AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT greatest({f32(f'max(abs(x)) / {d(448.0)}')}, {d(1e-12)}) AS sc FROM f),
v AS (SELECT label, x, {E4M3('x / sc')} * sc AS r FROM f, m) SELECT label, {REL} AS rel_rmse FROM v GROUP BY label""")
def naive_fp8(spark, path):
    """One scale for all: a one-row aggregate that every row meets."""
    e = emb(spark, path)
    sc = e.agg(F.greatest(N.f32(F.max(F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))) / 448.0), F.lit(1e-12)).alias("sc"))
    df = e.crossJoin(F.broadcast(sc))
    rec = F.transform(Q.values("embedding"), lambda v: N.e4m3(N.clamp(N.f32(v / F.col("sc")), -448, 448)) * F.col("sc"))
    return value_rows(df, rec).groupBy("label").agg(R6(M.rel_rmse()).alias("rel_rmse"))


@query(f"""WITH f AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT abs(avg(x)) + {d(3.5)} * stddev_samp(x) AS t FROM f),
v AS (SELECT label, x, abs(x) > t AS big, CASE WHEN abs(x) > t THEN {sql_bf16('x')} ELSE {E4M3(f"x / (t / {d(448.0)})")} * (t / {d(448.0)}) END AS r FROM f, m)
SELECT label, CAST(sum(CASE WHEN big THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers, {REL.replace(', 6)', ', 4)')} AS rel_rmse FROM v GROUP BY label""")
def outlier_fp8(spark, path):
    e = emb(spark, path)
    stats = Q.flat(e, "embedding").agg((F.abs(F.avg("x")) + 3.5 * F.stddev_samp("x")).alias("t"))
    df = e.crossJoin(F.broadcast(stats))
    t = F.col("t")
    rec = F.transform(Q.values("embedding"), lambda v: F.when(F.abs(v) > t, N.bf16(v)).otherwise(N.e4m3(N.clamp(N.f32(v / (t / 448.0)), -448, 448)) * (t / 448.0)))
    return value_rows(df, rec, "t").groupBy("label").agg(F.sum((F.abs("x") > t).cast("long")).alias("n_outliers"), F.round(M.rel_rmse(), 4).alias("rel_rmse"))


MASK = lambda x: f"(CASE WHEN {x} = 0 THEN {d(0.0)} ELSE trunc({x} / pow({d(2.0)}, floor(log2(abs({x}))) - 4)) * pow({d(2.0)}, floor(log2(abs({x}))) - 4) END)"


@query(f"WITH f AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), g AS (SELECT label, x, {sql_bf16('x')} AS y FROM f), v AS (SELECT label, x, {MASK('y')} AS r FROM g) SELECT label, {REL} AS rel_rmse FROM v GROUP BY label")
def mantissa_mask(spark, path):
    """bfloat16 with the low three mantissa bits cleared."""
    def cut(v):
        ulp = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(v))).cast("double") - 4)
        return F.when(v == 0, F.lit(0.0)).otherwise((v / ulp).cast("long") * ulp)

    rec = F.transform(F.transform(Q.values("embedding"), N.bf16), cut)
    return value_rows(emb(spark, path), rec).groupBy("label").agg(R6(M.rel_rmse()).alias("rel_rmse"))


@query(f"""WITH {sql_blocks(32)}, s AS (SELECT *, log2(greatest(list_max([abs(v) for v in x]), {d(1e-8)}) / {d(127.0)}) AS lg FROM b), m AS (SELECT min(lg) AS a, max(lg) AS z FROM s),
t AS (SELECT s.*, pow({d(2.0)}, {clamp(f"round_even((lg - a) / (z - a + {d(1e-12)}) * 255, 0)", 0, 255)} / {d(255.0)} * (z - a) + a) AS sc FROM s, m),
v0 AS (SELECT label, sc, unnest(x) AS x FROM t), v AS (SELECT label, x, {sql_bf16(clamp("round_even(x / sc, 0)", -128, 127) + " * sc")} AS r FROM v0) SELECT label, {REL.replace(', 6)', ', 4)')} AS rel_rmse FROM v GROUP BY label""")
def log8_scale(spark, path):
    """Scales on an 8-bit logarithmic grid between the least and the greatest of all blocks."""
    lg = F.transform(N.blocks(Q.values("embedding"), 32), lambda b: F.log2(N.absmax(b) / 127.0))
    e = emb(spark, path).withColumn("lg", lg)
    ends = e.agg(F.min(F.array_min("lg")).alias("a"), F.max(F.array_max("lg")).alias("z"))
    e = e.crossJoin(F.broadcast(ends))
    a, z = F.col("a"), F.col("z")
    scale = F.transform("lg", lambda g: F.pow(F.lit(2.0), N.clamp(F.rint((g - a) / (z - a + 1e-12) * 255), 0, 255) / 255.0 * (z - a) + a))
    e = e.withColumn("sc", scale)
    rec = F.flatten(F.zip_with(N.blocks(Q.values("embedding"), 32), F.col("sc"), lambda b, s: F.transform(b, lambda v: N.bf16(N.clamp(F.rint(v / s), -128, 127) * s))))
    return value_rows(e, rec).groupBy("label").agg(F.round(M.rel_rmse(), 4).alias("rel_rmse"))


@query(f"WITH {sql_values(sql_sym(32, 127, lambda x: sql_grid(x, 4, -6)))} SELECT label, {REL} AS rel_rmse FROM v GROUP BY label")
def fp8_scale(spark, path):
    code = Q.block_struct(N.symmetric(Q.values("embedding"), 32, 127, N.e4m3))
    return value_rows(emb(spark, path).withColumn("code", code)).groupBy("label").agg(R6(M.rel_rmse()).alias("rel_rmse"))


COMPARED = ("sym", "adaptive", "int4", "int3", "amo_fast", "amo_balanced", "amo_accurate", "amo_max")


def sql_mode(mode: str, group: int) -> str:
    if mode in Q.LEVELS:
        body = f"WITH {sql_values(sql_sym(group, Q.LEVELS[mode]))}"
    else:
        inner = (sql_adaptive() if mode == "adaptive" else sql_amo(mode.removeprefix("amo_"))).replace(sql_blocks(32), sql_blocks(group))
        head, tail = inner.rsplit("SELECT vec_id", 1)
        if mode == "adaptive":
            body = head.rstrip() + f", v0 AS (SELECT st AS sc, unnest(x) AS x FROM p), v AS (SELECT x, {sql_bf16(clamp('round_even(x / sc, 0)', -128, 127) + ' * sc')} AS r FROM v0)"
        else:
            body = head.rstrip() + f", v0 AS (SELECT sc, zp, {sql_bf16('sc')} AS st, unnest(x) AS x FROM w WHERE rn = 1), v AS (SELECT x, {sql_bf16('(' + clamp('round_even(x / sc + zp, 0)', 0, 255) + ' - zp) * st')} AS r FROM v0)"
    return f"SELECT * FROM ({body} SELECT '{mode}' AS mode, {REL} AS rel_rmse, {d(Q.bytes_per_value(mode, group))} AS bytes_per_value FROM v)"


@query(" UNION ALL ".join(sql_mode(m, 32) for m in COMPARED))
def mode_compare(spark, path):
    per = F.create_map(*[F.lit(x) for m in COMPARED for x in (m, Q.bytes_per_value(m, 32))])
    return tried(spark, path, [(m, 32) for m in COMPARED]).select("mode", "rel_rmse", F.element_at(per, F.col("mode")).alias("bytes_per_value"))


WIDTHS = ("sym", "int7", "int6", "int5", "int4", "int3")


@query(" UNION ALL ".join(f"SELECT mode, rel_rmse FROM ({sql_mode(m, 32)})" for m in WIDTHS))
def int_widths(spark, path):
    """Error of symmetric codes of 8 to 3 bits."""
    return tried(spark, path, [(m, 32) for m in WIDTHS]).select("mode", "rel_rmse")


@query(f"WITH {sql_values(sql_sym(32, 7))} SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(abs(x - r)), 6) AS mae, round(max(abs(x - r)), 9) AS max_err, CAST(count(*) FILTER (r = 0) AS BIGINT) AS zeros FROM v GROUP BY label")
def error_spread(spark, path):
    """Mean and greatest absolute error of 4-bit codes, and how many values become zero."""
    rows = value_rows(sym(spark, path, 32, "int4"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(F.abs(F.col("x") - F.col("r")))).alias("mae"), F.round(F.max(F.abs(F.col("x") - F.col("r"))), 9).alias("max_err"), F.count(F.when(F.col("r") == 0, True)).alias("zeros"))


ORDER = ("amo_fast", "amo_balanced", "amo_accurate", "amo_max")
TARGET = 0.5


def choose(rows: DataFrame, target: float = TARGET) -> DataFrame:
    """The first (group, mode), in the order tried, whose error is within the target; else the last."""
    ok = F.min_by(F.struct("group_size", "mode"), F.when(F.col("rel_rmse") <= target, F.col("k")))
    return rows.agg(F.coalesce(ok, F.max_by(F.struct("group_size", "mode"), "k")).alias("c")).select("c.group_size", "c.mode")


@query("WITH t AS (" + " UNION ALL ".join(f"SELECT {k} AS k, {g} AS group_size, * FROM ({sql_mode(m, g)})" for k, (g, m) in enumerate((g, m) for g in (32, 16) for m in ORDER)) + f") SELECT CAST(group_size AS INTEGER) AS group_size, mode FROM t WHERE k = coalesce((SELECT min(k) FROM t WHERE rel_rmse <= {d(TARGET)}), (SELECT max(k) FROM t))")
def auto_select(spark, path):
    return choose(tried(spark, path, [(m, g) for g in (32, 16) for m in ORDER]))


@query(f"WITH t AS (SELECT CAST(sum(len(embedding)) AS BIGINT) AS numel FROM embeddings) SELECT g AS group_size, numel, CAST(ceil(numel / CAST(g AS DOUBLE)) AS BIGINT) AS num_blocks, numel + 3 * CAST(ceil(numel / CAST(g AS DOUBLE)) AS BIGINT) AS total_bytes, round({d(2.0)} / (1 + {d(3.0)} / g), 9) AS ratio_vs_bf16 FROM t, (SELECT CAST(unnest([8, 16, 32, 64, 128, 256]) AS INTEGER) AS g)")
def estimate_sizes(spark, path):
    t = emb(spark, path).agg(F.sum(F.size("embedding")).alias("numel")).withColumn("group_size", F.explode(F.array(*[F.lit(g) for g in (8, 16, 32, 64, 128, 256)])))
    nb = F.ceil(F.col("numel") / F.col("group_size"))
    return t.select("group_size", "numel", nb.alias("num_blocks"), (F.col("numel") + 3 * nb).alias("total_bytes"), F.round(2.0 / (1 + 3.0 / F.col("group_size")), 9).alias("ratio_vs_bf16"))


@query(f"""WITH {sql_values(sql_sym())} SELECT label, CAST(count(*) AS BIGINT) AS n, {REL} AS rel_rmse, round({d(100.0)} * avg(abs(x - r)) / (avg(abs(x)) + {d(1e-12)}), 6) AS mape, round(max(abs(x - r)), 9) AS max_err,
round(20 * log10((max(x) - min(x)) / sqrt(avg((x - r) * (x - r)))), 6) AS psnr, round(least({d(1.0)}, sum(x * r) / sqrt(sum(x * x) * sum(r * r))), 9) AS cos_sim FROM v GROUP BY label""")
def tensor_metrics(spark, path):
    m = M.tensor_metrics(value_rows(sym(spark, path)), "label")
    return m.select("label", "n", R6("rel_rmse").alias("rel_rmse"), R6("mape").alias("mape"), F.round("max_err", 9).alias("max_err"), R6("psnr").alias("psnr"), F.round("cos_sim", 9).alias("cos_sim"))


@query(f"""WITH {sql_values(sql_sym())}, m AS (SELECT label, abs(x) AS m, CAST(count(*) AS BIGINT) AS n, sum(abs(x - r)) AS e FROM v GROUP BY label, abs(x)),
k AS (SELECT label, greatest(1, CAST(floor(sum(n) * {d(0.001)}) AS BIGINT)) AS k FROM m GROUP BY label),
t AS (SELECT m.*, k, coalesce(sum(n) OVER (PARTITION BY m.label ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM m JOIN k ON m.label = k.label),
p AS (SELECT *, least(n, k - bef) AS c, least(n, k - bef) / CAST(n AS DOUBLE) AS part FROM t WHERE bef < k)
SELECT label, CAST(sum(c) AS BIGINT) AS k, round({d(100.0)} * sum(e * part) / (sum(m * n * part) + {d(1e-12)}), 6) AS outlier_err FROM p GROUP BY label""")
def outlier_error_topk(spark, path):
    return M.outlier_error(value_rows(sym(spark, path)), 0.001, "label").select("label", "k", R6("outlier_err").alias("outlier_err"))


@query(f"WITH {sql_values(sql_sym())}, m AS (SELECT vec_id, round(sum((x - r) * (x - r)) / count(*), 12) AS mse FROM v GROUP BY vec_id) (SELECT 'top' AS side, * FROM m ORDER BY mse DESC, vec_id LIMIT 5) UNION ALL (SELECT 'bottom' AS side, * FROM m ORDER BY mse, vec_id LIMIT 5)")
def token_sensitivity(spark, path):
    """The five vectors of greatest and of least error (a top-k report)."""
    x, r = Q.values("embedding"), Q.decode(F.col("code"))
    m = sym(spark, path).select("vec_id", F.round(N.total(F.zip_with(x, r, lambda a, b: (a - b) * (a - b))) / F.size("embedding"), 12).alias("mse"))
    side = lambda name, by: m.orderBy(by, "vec_id").limit(5).select(F.lit(name).alias("side"), "vec_id", "mse")
    return side("top", F.desc("mse")).unionByName(side("bottom", F.asc("mse")))


@query(f"WITH {sql_values(sql_sym())} SELECT CAST(block * 32 + i AS BIGINT) AS channel, round(sum((x - r) * (x - r)) / count(*), 10) AS mse FROM v GROUP BY block * 32 + i")
def channel_sensitivity(spark, path):
    return value_rows(sym(spark, path)).groupBy(F.col("pos").cast("long").alias("channel")).agg(F.round(M.sse() / F.count(F.lit(1)), 10).alias("mse"))


@query(f"""WITH {sql_values(sql_sym())}, m AS (SELECT label, vec_id, block, round(sum((x - r) * (x - r)), 9) AS e FROM v GROUP BY label, vec_id, block)
SELECT label, vec_id, CAST(block AS BIGINT) AS block, round(sum(e) OVER (PARTITION BY label ORDER BY e DESC, vec_id, block ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY label), 6) AS share FROM m""")
def cumulative_error_share(spark, path):
    x, r = N.blocks(Q.values("embedding"), 32), F.transform("code", lambda b: F.transform(b["q"], lambda q: N.bf16(q * b["scale"])))
    err = F.zip_with(x, r, lambda a, b: F.round(N.total(F.zip_with(a, b, lambda u, v: (u - v) * (u - v))), 9))
    m = sym(spark, path).select("label", "vec_id", F.posexplode(err).alias("block", "e"))
    m = running(m, ["label"], [F.desc("e"), F.col("vec_id"), F.col("block")], "e")
    return m.select("label", "vec_id", F.col("block").cast("long").alias("block"), R6((F.col("before") + F.col("e")) / F.col("total")).alias("share"))


@query(f"WITH {sql_blocks(32)}, g AS (SELECT label, list_max(x) - list_min(x) AS w FROM b) SELECT label, round(quantile_cont(w, {d(0.05)}), 6) AS p5, round(quantile_cont(w, {d(0.5)}), 6) AS p50, round(quantile_cont(w, {d(0.95)}), 6) AS p95, round(avg(CASE WHEN w < {d(0.5)} THEN {d(1.0)} ELSE {d(0.0)} END), 6) AS narrow FROM g GROUP BY label")
def range_quantiles(spark, path):
    """Exact quantiles by rank: rows are numbered through range partitions and the two around each place are picked."""
    g = emb(spark, path).select("label", F.explode(F.transform(N.blocks(Q.values("embedding"), 32), lambda b: F.array_max(b) - F.array_min(b))).alias("w")).withColumn("one", F.lit(1).cast("long"))
    g = running(g, ["label"], [F.asc("w")], "one")
    last, narrow = F.col("total") - 1, F.sum((F.col("w") < 0.5).cast("long"))

    def quantile(q):
        at = last * F.lit(q)
        pick = lambda k: F.max(F.when(F.col("before") == k, F.col("w")))
        return pick(F.floor(at)), pick(F.ceil(at)), F.max(at - F.floor(at))

    parts = {n: quantile(q) for n, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))}
    t = g.groupBy("label").agg((narrow / F.count(F.lit(1))).alias("narrow"), *[c.alias(f"{n}_{k}") for n, cs in parts.items() for k, c in zip("abt", cs, strict=True)])
    return t.select("label", *[R6(F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * F.col(f"{n}_t")).alias(n) for n in parts], R6("narrow").alias("narrow"))


BAD = "CASE WHEN vec_id % 5 = 0 AND i % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN vec_id % 5 = 1 AND i < 32 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(v AS DOUBLE) END"


@query(f"""WITH f AS (SELECT vec_id, i, {BAD} AS y FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS v FROM embeddings)),
g AS (SELECT vec_id, i // 32 AS block, CASE WHEN isfinite(y) THEN y ELSE {d(0.0)} END AS x, isfinite(y) AS ok FROM f),
s AS (SELECT vec_id, block, {sql_bf16(f32(f'greatest(max(abs(x)), {d(1e-8)}) / {d(127.0)}'))} AS sc FROM g GROUP BY vec_id, block)
SELECT vec_id, CAST(block AS BIGINT) AS block, any_value(sc) AS scale, CAST(sum(CASE WHEN ok THEN {clamp('round_even(' + f32('x / sc') + ', 0)', -128, 127)} ELSE 0 END) AS BIGINT) AS sum_q, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_bad FROM g JOIN s USING (vec_id, block) GROUP BY vec_id, block""")
def nonfinite_blocks(spark, path):
    """Symmetric codes of vectors with NaN and infinities put in by position: those code 0 and leave scales alone."""
    k = F.col("vec_id") % 5
    bad = F.transform(Q.values("embedding"), lambda v, i: F.when((k == 0) & (i % 7 == 0), F.lit(float("nan"))).when((k == 1) & (i < 32), F.lit(float("inf"))).otherwise(v))
    e = emb(spark, path).withColumn("embedding", bad)
    lost = F.transform(N.blocks(F.col("embedding"), 32), lambda b: F.size(F.filter(b, lambda v: ~N.finite(v))))
    b = Q.encode(e, "embedding", "sym").select("vec_id", F.explode(F.arrays_zip("code", lost.alias("lost"))).alias("z"))
    return b.select("vec_id", F.col("z.code.block").cast("long").alias("block"), F.col("z.code.scale").alias("scale"), F.aggregate("z.code.q", F.lit(0), lambda a, v: a + v).cast("long").alias("sum_q"), F.col("z.lost").cast("long").alias("n_bad"))


@query(f"""WITH {sql_values(sql_sym())}, w AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS row_), f AS (SELECT vec_id, block * 32 + i AS col, r FROM v)
SELECT vec_id, CAST(row_ AS BIGINT) AS out_row, round(sum(r * CAST((row_ * 7 + col * 3) % 11 - 5 AS DOUBLE)) + row_, 5) AS y FROM f, w GROUP BY vec_id, row_""")
def dequant_linear(spark, path):
    """decoded @ W.T + b with a small fixed W."""
    w = spark.range(4).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("col"))
    w = w.withColumn("w", ((F.col("row") * 7 + F.col("col") * 3) % 11 - 5).cast("double"))
    y = Q.dequant_linear(sym(spark, path).select("vec_id", "code"), "vec_id", "code", w)
    return y.select("vec_id", F.posexplode("y").alias("out_row", "v")).select("vec_id", F.col("out_row").cast("long").alias("out_row"), F.round(F.col("v") + F.col("out_row"), 5).alias("y"))


@query()
def scale_searches(spark, path):
    """Error of the six research scale searches over all blocks of 32."""
    import numpy as np
    import pyarrow as pa

    methods = ("stored_scale", "decoded_score", "zero_range", "wire_grid", "lattice_refine", "wide_grid")

    def run(batches):
        for b in batches:
            rows = [np.array(r, np.float64) for r in b.column(0).to_pylist() if r]
            if not rows:
                continue
            x = np.concatenate([S.to_blocks(r, 32) for r in rows])
            for m in methods:
                q, s, zp = S.scale_search(x, m)
                yield pa.record_batch({"method": pa.array([m]), "sse": pa.array([float(((x - S.bf16((q - zp[:, None]) * s[:, None])) ** 2).sum())]), "energy": pa.array([float((x * x).sum())])})

    sums = emb(spark, path).select(Q.values("embedding").alias("x")).mapInArrow(run, "method string, sse double, energy double")
    return sums.groupBy("method").agg(R6(100.0 * F.sqrt(F.sum("sse")) / F.sqrt(F.sum("energy"))).alias("rel_rmse"))
