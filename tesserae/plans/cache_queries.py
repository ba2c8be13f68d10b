"""Cache queries over `embeddings`: sharding, lookups, batches, appends. Caches go to the folder named by spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.functions import numerics as N
from tesserae.operators import quantize as Q
from tesserae.plans.quant_queries import R6, emb, sql_sym, sql_values
from tesserae.sources import feature_cache as C
from tesserae.sources.tables import shared

QUERIES: dict = {}
SQL: dict[str, str] = {}
SHARDS = 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def scratch(spark, name: str) -> str:
    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cache(spark, path, shards=SHARDS, mode="sym"):
    """A cache of all vectors, numbered by vec_id."""
    at = scratch(spark, "features")
    src = C.numbered(emb(spark, path).select("vec_id", "embedding"), "vec_id")
    dim = spark.read.parquet(f"{path}/embeddings.parquet").agg(F.max(F.size("embedding"))).first()[0]
    C.FeatureCacheWriter(spark, at, C.Settings(dim, 32, mode, shards)).write(src, "embedding", "sample_id")
    return C.FeatureCacheDataset(spark, at)


POS = "n AS (SELECT *, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS sample_id, CAST(count(*) OVER () AS BIGINT) AS total FROM embeddings)"
SHARD = f"CAST(CASE WHEN sample_id < (total % {SHARDS}) * (total // {SHARDS} + 1) THEN sample_id // (total // {SHARDS} + 1) ELSE (total % {SHARDS}) + (sample_id - (total % {SHARDS}) * (total // {SHARDS} + 1)) // (total // {SHARDS}) END AS INTEGER)"


@query(f"WITH {POS} SELECT sample_id, {SHARD} AS shard FROM n")
def shard_assign(spark, path):
    return cache(spark, path).codes().select("sample_id", "shard")


DECODED = f"{sql_values(sql_sym())}, t AS (SELECT vec_id, round(sum(r), 6) AS sum_r FROM v GROUP BY vec_id), {POS}, j AS (SELECT n.sample_id, n.total, t.sum_r FROM n JOIN t USING (vec_id))"
sum_r = lambda: R6(N.total(F.col("decoded"))).alias("sum_r")


@query(f"WITH {DECODED} SELECT sample_id, sum_r FROM j WHERE {SHARD} = 1")
def shard_scan(spark, path):
    """The second reader of three: one partition of the cache."""
    whole = cache(spark, path)
    return C.FeatureCacheDataset(spark, whole.path, rank=1, world_size=SHARDS).decoded().select("sample_id", sum_r())


@query(f"WITH {DECODED} SELECT sample_id, sum_r FROM j WHERE sample_id IN (7, total - 1)")
def point_lookup(spark, path):
    c = cache(spark, path)
    return c.get(7).unionByName(c.get(-1)).select("sample_id", sum_r())


@query(f"WITH {DECODED} SELECT CAST(sample_id // 128 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n, round(sum(sum_r), 4) AS sum_r FROM j GROUP BY 1")
def batch_iter(spark, path):
    rows = cache(spark, path).batches(128).select("batch_id", N.total(F.col("decoded")).alias("s"))
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round("s", 6)), 4).alias("sum_r"))


@query(f"WITH {POS} SELECT CAST(sample_id // 96 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n FROM n WHERE sample_id // 96 < total // 96 GROUP BY 1")
def drop_last(spark, path):
    return cache(spark, path).batches(96, drop_last=True).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POS} SELECT CAST(k AS BIGINT) AS batch_id, CAST(least(64, total - k * 64) AS BIGINT) AS n, CAST(least(64, total - k * 64) AS BIGINT) AS n_distinct FROM (SELECT DISTINCT total, unnest(range(0, (total + 63) // 64)) AS k FROM n)")
def shuffled_batches(spark, path):
    """An epoch in a seeded order: each sample once, batches full but the last."""
    return cache(spark, path).batches(64, shuffle=True, seed=11).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("n_distinct"))


@query(f"WITH {POS} SELECT DISTINCT n.sample_id, n.vec_id FROM n JOIN (SELECT CAST(floor(i * (total - 1) / CAST(49 AS DOUBLE)) AS BIGINT) AS s FROM (SELECT DISTINCT total, unnest(range(0, 50)) AS i FROM n)) ON s = n.sample_id")
def evenly_spaced_sample(spark, path):
    """Fifty samples at equal distances (a sampling operator): a semi-join on computed positions."""
    src = C.numbered(emb(spark, path).select("vec_id"), "vec_id")
    total = src.agg(F.max("sample_id").alias("last"))
    want = total.select(F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i"), "last").select(F.floor(F.col("i") * F.col("last") / F.lit(49.0)).cast("long").alias("sample_id"))
    return src.join(want.distinct(), "sample_id", "left_semi").select("sample_id", "vec_id")


@query(f"WITH {DECODED} SELECT sample_id, sum_r, true AS same FROM j")
def append_roundtrip(spark, path):
    """A cache written in two steps decodes as one written at once."""
    whole = cache(spark, path, 1)
    src = C.numbered(emb(spark, path).select("vec_id", "embedding"), "vec_id")
    half = len(whole) // 2
    at = scratch(spark, "grown")
    w = C.FeatureCacheWriter(spark, at, C.Settings(whole.meta["dim"], 32, "sym", 1))
    w.write(src.where(F.col("sample_id") < half), "embedding", "sample_id")
    w.append(src.where(F.col("sample_id") >= half), "embedding", "sample_id")
    grown = C.FeatureCacheDataset(spark, at).decoded().select("sample_id", F.col("decoded").alias("other"))
    return whole.decoded().join(grown, "sample_id", "full").select("sample_id", sum_r(), F.col("decoded").eqNullSafe(F.col("other")).alias("same"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS num_samples, CAST({SHARDS} AS INTEGER) AS num_shards, CAST(sum(len(embedding) + 2 * ceil(len(embedding) / CAST(32 AS DOUBLE))) AS BIGINT) AS code_bytes, CAST(sum(4 * len(embedding)) AS BIGINT) AS raw_bytes FROM embeddings")
def cache_summary(spark, path):
    c = cache(spark, path)
    code = F.octet_length("q") + 2 * F.size("scale_bits")
    return c.codes().agg(F.count(F.lit(1)).alias("num_samples"), F.lit(c.meta["num_shards"]).alias("num_shards"), F.sum(code.cast("long")).alias("code_bytes"), F.sum((4 * F.octet_length("q")).cast("long")).alias("raw_bytes"))


STORED_MODES = {"sym": (1.0, 2), "amo_balanced": (1.0, 3), "int4": (0.5, 2), "int3": (0.375, 2)}


@query(" UNION ALL ".join(f"SELECT '{m}' AS mode, CAST(count(*) AS BIGINT) AS num_samples, CAST(sum(ceil(len(embedding) * CAST({v} AS DOUBLE)) + {b} * ceil(len(embedding) / CAST(32 AS DOUBLE))) AS BIGINT) AS stored_bytes FROM embeddings" for m, (v, b) in STORED_MODES.items()))
def stored_bytes(spark, path):
    """Bytes that caches of four modes hold, counted in what is stored: codes, scales and zero points."""
    out = None
    for mode in STORED_MODES:
        size = F.octet_length("q") + 2 * F.size("scale_bits") + F.coalesce(F.octet_length("zp"), F.lit(0))
        one = cache(spark, path, SHARDS, mode).codes().agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("num_samples"), F.sum(size.cast("long")).alias("stored_bytes"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {POS} SELECT {SHARD} AS shard, CAST(1 AS BIGINT) AS layouts, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY 1")
def cache_layout_check(spark, path):
    """Number of distinct block layouts by shard: one, or the cache could not be read with a fixed stride."""
    layout = F.concat_ws(":", F.octet_length("q"), F.size("scale_bits"))
    return cache(spark, path).codes().groupBy("shard").agg(F.countDistinct(layout).alias("layouts"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {DECODED} SELECT sample_id, sum_r FROM j WHERE sample_id IN (SELECT label + CAST(vec_id * 3 AS BIGINT) FROM embeddings)")
def gather_ids(spark, path):
    """Ids computed from every row of the table, with repeats and ids that no sample has, gathered by a semi-join of packed rows."""
    ids = spark.read.parquet(f"{path}/embeddings.parquet").select((F.col("label") + F.col("vec_id") * 3).cast("long").alias("sample_id"))
    return cache(spark, path).gather(ids).select("sample_id", sum_r())
