"""Helpers shared by the pipeline operators: shared storage, text rules, graph components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Sorted component rounds stop here; each round at least halves the longest chain, so 64 is never met.
MAX_ROUNDS = 64


#: What one Arrow batch may hold: 8 MB where the session leaves the default of 64 MB, of which Python holds several copies.
ARROW_BYTES, DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the session was started without it on their path, and bound Arrow batches."""
    if spark.conf.get(ARROW_BYTES, DEFAULT_BYTES) == DEFAULT_BYTES:
        spark.conf.set(ARROW_BYTES, "8m")
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")) if p]
    if ROOT not in os.pathsep.join(paths).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one is set only for a session in one process that has none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        sc.setCheckpointDir(at)
        return at
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in shared storage; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back (columnar, so later reads prune columns)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this code made in shared storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame) -> bool:
    """Whether Spark would broadcast a table by its size on disk."""
    most = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= int(df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


#: What stands between words: ASCII white space; ASCII but letters and digits.
SPACES = r"[\x20\x09-\x0D]+"
MARKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text: Column, sep: str) -> Column:
    """The words between separators; null counts as empty. (Splitting takes a tenth of the time of extracting.)"""
    empty = lambda c: (c == "").cast("int")
    return let(
        F.split(F.coalesce(text, F.lit("")), sep, -1),
        lambda a: F.slice(a, empty(F.element_at(a, 1)) + 1, F.greatest(F.size(a) - empty(F.element_at(a, 1)) - empty(F.element_at(a, -1)), F.lit(0))),
    )


def count_words(text: Column, sep: str) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), sep, -1)
    empty = lambda c: (c == "").cast("int")
    return F.greatest(F.size(parts) - empty(F.element_at(parts, 1)) - empty(F.element_at(parts, -1)), F.lit(0)).cast("long")


CHUNK = 512


def match_spans(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,hit>> in code points, end exclusive.

    Built from the pieces between matches, so no Python is needed. The pattern must never match
    the empty string.
    """
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.call_function("split", text, p, F.lit(-1))
    pairs = let(hits, lambda h: F.zip_with(F.slice(gaps, F.lit(1), F.size(h)), h, lambda g, x: F.struct(F.length(g).alias("g"), x.alias("hit"))))
    return let(pairs, lambda v: F.when(F.size(v) > 0, placed(v)).otherwise(no_spans()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once (inside higher-order functions nothing else shares it)."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def placed(pairs: Column) -> Column:
    """Running offsets over array<struct<g,hit>>; in chunks, as appending to one array takes quadratic time."""
    width = lambda x: x["g"] + F.length(x["hit"])
    split = F.transform(F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(CHUNK)), lambda i: F.slice(pairs, i + 1, F.lit(CHUNK)))

    def bases(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + width(x)))
        return F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def place(chunk: Column, base: Column) -> Column:
        zero = F.struct(base.alias("at"), no_spans().alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start, end = acc["at"] + x["g"], acc["at"] + width(x)
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

        return F.aggregate(chunk, zero, step, lambda acc: acc["out"])

    return let(split, lambda chunks: F.flatten(F.zip_with(chunks, F.slice(bases(chunks), F.lit(1), F.size(chunks)), place)))


def no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")


#: Keys with more than this share of a table's rows (fewer than 1 / HOT_SHARE, so) are joined apart.
HOT_SHARE, HOT_ROWS = 1 / 1000, 128


#: Narrow rows that are worth a task of their own.
TASK_ROWS = 50_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """A stored table of about so many narrow rows in as many tasks as they need (never more than it has)."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def few(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """A narrow table of about so many rows in a task for each core or for each `each` rows, where Spark merges no partitions by itself.

    Each task that writes leaves a file, for which Hadoop's local file system starts processes of its own.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """left joined with right (one row for each key at most), "inner" or "left", without bringing a hot key into one task.

    left is counted here, so it should be a stored table (of about `rows` rows, if known). Its hot keys, at most 1 / HOT_SHARE by
    definition, meet a broadcast of their rows of right; all other keys are shuffled; rows without a
    key meet nothing.
    """
    rest = left.where(F.col(key).isNotNull())
    counts = rest.groupBy(key).agg(F.count(F.lit(1)).alias("sj_n"))
    total, top = (counts if rows is None else packed(counts, rows)).agg(F.sum("sj_n"), F.max("sj_n")).first()
    most = max(HOT_ROWS, int((total or 0) * HOT_SHARE))
    hot = [r[0] for r in counts.where(F.col("sj_n") > most).select(key).collect()] if (top or 0) > most else []
    parts = [rest]
    if hot:
        at = F.col(key).isin(hot)
        parts = [rest.where(~at)]
    out = parts[0].join(right, key, how)
    if hot:
        out = out.unionByName(rest.where(at).join(F.broadcast(right.where(at)), key, how))
    if how == "left":
        added = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
        out = out.unionByName(left.where(F.col(key).isNull()).select("*", *added))
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star contraction.

    edges: columns a, b (long), any direction, repeats allowed. Returns (id, component) for every
    vertex that has a link to another; component is the smallest id reachable. All steps are
    aggregates and equi-joins; those by centre, which may be hot, go through `spread_join` (a large
    star leaves a vertex but one link for each least vertex around it, so the small star has no hot
    key); nothing is collected but some numbers a round and the few hot centres.
    """
    spark = edges.sparkSession

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def least(e: DataFrame, key: str) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", key)

    # every edge is kept as a > b
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(e)
    if not seen[0]:
        return spark.createDataFrame([], "id long, component long")
    for _ in range(MAX_ROUNDS):
        n = seen[0]
        e = packed(e, n)
        # large star: what is above b moves to the least that b knows; small star: all that a knows moves to the least of it
        large = packed(checkpoint(spread_join(e, least(e, "b"), "b", "left", n).select("a", F.coalesce("m", "b").alias("b")).distinct()), n)
        small = large.join(least(large, "a"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = checkpoint(small)
        now = mark(packed(e, n))
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").unionByName(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def ranked(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based place of each row within its group, without bringing a group into one task.

    Rows are range-partitioned by group and order; a row's place is the rows of its group in
    earlier partitions (one small count for each group and partition) plus its place in its own.
    The partitioned rows are checkpointed, so that a task that runs again can't see other bounds.
    """
    p = checkpoint(df.repartitionByRange(F.col(group), *order).select("*", F.spark_partition_id().alias("rk_part")))
    counts = p.groupBy(group, "rk_part").agg(F.count(F.lit(1)).alias("rk_n"))
    before = Window.partitionBy(group).orderBy("rk_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("rk_group"), F.col("rk_part").alias("rk_p"), F.coalesce(F.sum("rk_n").over(before), F.lit(0)).alias("rk_before"))
    own = Window.partitionBy(group, "rk_part").orderBy(*order)
    p = p.withColumn("rk_own", F.row_number().over(own))
    out = p.join(counts, p[group].eqNullSafe(counts["rk_group"]) & (p["rk_part"] == counts["rk_p"]))
    return out.withColumn(name, F.col("rk_before") + F.col("rk_own")).drop("rk_part", "rk_group", "rk_p", "rk_before", "rk_own")
