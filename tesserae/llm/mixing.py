"""Mixing sources to target weights by systematic sampling.

Each source gets a share of the words (by weight, at most MAX_REPEAT times its own words, the
excess reshared). All documents of a source have the same expected number of copies. Their prefix
sums, plus one random offset for the source, cross integers; a document is emitted once for each
integer that it crosses. Documents stand in order of size, which keeps the words taken close to the
target: the error of a source is less than its longest document.

Defined results: a null source is a source of its own, after all others; null and empty texts have
size 0; in a source without words nothing is taken; rows that agree in id, source and size are
interchangeable; very long texts only count their words; an empty table gives an empty one; other
columns, of whatever name but a prefix `mx_`, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import SPACES, checkpoint, count_words, ranked, stored

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = 17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """(source, src_no, source_size, target, expected, offset) from rows (source, size); one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("src_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src_no") - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    # by the ratio of cap to weight: a source is capped if its share of what smaller ratios leave is above its cap
    rank = Window.orderBy(F.col("cap") / F.col("w"), "src_no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(rank), F.lit(0.0))
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(rank), F.lit(0.0))
    s = s.withColumn("level", left / rest).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * level))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("source", "src_no", "source_size", "target", expected.alias("expected"), unit.alias("offset"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row for each row of docs."""
    narrow = checkpoint(docs.select("doc_id", "source", count_words(F.col("text"), SPACES).alias("size")))
    sources = checkpoint(source_targets(narrow, weights, max_repeat, seed))
    # number the sources: ranking then moves no strings, and null is a source like others
    n = narrow.withColumnRenamed("source", "nsource")
    rows = n.join(sources.select("source", "src_no"), n["nsource"].eqNullSafe(sources["source"])).select("doc_id", "src_no", "size")
    rows = ranked(rows, "src_no", [F.col("size").desc(), F.col("doc_id").asc_nulls_last()])
    at = lambda k: F.floor(k * F.col("expected") + F.col("offset"))
    taken = F.least(at(F.col("rank")) - at(F.col("rank") - 1), F.lit(max_repeat)).cast("long")
    return rows.join(sources, "src_no").select("doc_id", "source", "size", "source_size", "target", taken.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as it is taken.

    Rows meet their number of copies by a hash of id, source and size. Texts stay where they are
    while Spark would broadcast those numbers by their size, and are shuffled, unsorted, beyond. Only
    rows that agree in all three are numbered first, as some of them may be taken more often.
    """
    n = lambda v: F.count(F.when(F.col("copies") == v, True)).alias(f"mx_{v}")
    key = F.xxhash64("doc_id", "source", count_words(F.col("text"), SPACES))
    c = copies(docs, weights, max_repeat, seed).groupBy(F.xxhash64("doc_id", "source", "size").alias("mx_key")).agg(F.count(F.lit(1)).alias("mx_n"), *[n(v) for v in range(1, max_repeat + 1)])
    c = stored(c.where(sum(F.col(f"mx_{v}") for v in range(1, max_repeat + 1)) > 0), "copies")
    once = c.where("mx_n = 1").select(F.col("mx_key").alias("mx_own"), sum(v * F.col(f"mx_{v}") for v in range(1, max_repeat + 1)).cast("int").alias("mx_copies"))
    out = docs.join(once.hint("shuffle_hash"), key == F.col("mx_own"))
    several = c.where("mx_n > 1").withColumnRenamed("mx_key", "mx_own")
    if several.limit(1).count():
        same = docs.join(several.hint("shuffle_hash"), key == F.col("mx_own")).withColumn("mx_id", F.monotonically_increasing_id())
        same = ranked(same, "mx_own", [F.xxhash64("text"), F.col("mx_id")], "mx_r")
        times, upto = F.lit(0), F.lit(0)
        for v in range(max_repeat, 0, -1):  # the first rows are taken most often
            times = F.when((times == 0) & (F.col("mx_r") <= upto + F.col(f"mx_{v}")), F.lit(v)).otherwise(times)
            upto = upto + F.col(f"mx_{v}")
        out = out.unionByName(same.select(*docs.columns, "mx_own", times.alias("mx_copies")))
    return out.where("mx_copies > 0").withColumn("mx_copy", F.explode(F.sequence(F.lit(1), F.col("mx_copies")))).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """The columns of op3."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src_no FROM s0
), s2 AS (SELECT *, CAST(1 + (src_no - 1) % 3 AS DOUBLE) AS w, CAST({MAX_REPEAT} AS DOUBLE) * source_size AS cap FROM s1
), s3 AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER r, CAST(0 AS DOUBLE))) / (sum(w) OVER () - coalesce(sum(w) OVER r, CAST(0 AS DOUBLE))) AS lvl
  FROM s2 WINDOW r AS (ORDER BY cap / w, src_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s4 AS (SELECT *, cap <= w * lvl AS capped FROM s3
), s5 AS (SELECT *, CASE WHEN capped THEN cap ELSE w * max(CASE WHEN NOT capped THEN lvl END) OVER () END AS target FROM s4
), s AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE CAST(0 AS DOUBLE) END AS e,
    CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce('=' || source, '')), 1, 8) AS UBIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS u FROM s5
), r AS (
  SELECT d.doc_id, d.source, d.size, s.source_size, s.target, s.e, s.u, row_number() OVER (PARTITION BY s.src_no ORDER BY d.size DESC, d.doc_id) AS k
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), c AS (SELECT *, CAST(least(floor(k * e + u) - floor((k - 1) * e + u), {MAX_REPEAT}) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
"""
