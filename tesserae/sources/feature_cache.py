"""Feature caches: Parquet tables of packed block codes, one row per sample, partitioned by shard, with one-row metadata tables.

Every write or append puts its rows into a commit folder of its own and then publishes a new version
of the metadata, which names the commits that count. A reader takes the last whole version, so a
write that fails half way leaves the cache as it was, and its rows are never seen, not even after
the next append. Every setting is checked against the stored metadata before a file is touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import packed as P
from tesserae.operators import quantize as Q
from tesserae.sources.tables import newest, publish, settled, sweep

META = T.StructType([
    T.StructField("num_samples", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("group_size", T.IntegerType()),
    T.StructField("mode", T.StringType()), T.StructField("num_shards", T.IntegerType()), T.StructField("shard_sizes", T.ArrayType(T.LongType())),
    T.StructField("seq_len", T.IntegerType()), T.StructField("commits", T.ArrayType(T.StringType())),
])
DATA = f"sample_id long, {P.STORED}"


@dataclass(frozen=True)
class Settings:
    dim: int
    group_size: int = 32
    mode: str = "amo_balanced"
    num_shards: int = 1
    seq_len: int = 1

    @property
    def width(self) -> int:
        """Values of a sample: seq_len vectors of dim."""
        return self.seq_len * self.dim

    def __post_init__(self) -> None:
        if self.mode not in Q.MODES:
            raise ValueError(f"unknown mode {self.mode}")
        if min(self.group_size, self.dim, self.num_shards, self.seq_len) <= 0:
            raise ValueError("dim, seq_len, group_size and num_shards must be positive")


def shard_of(position, total: int, shards: int):
    """Contiguous shards; the first total mod shards hold one sample more."""
    small, extra = divmod(total, shards)
    edge = extra * (small + 1)
    if small == 0:
        return position.cast("int")
    return F.when(position < edge, F.floor(position / (small + 1))).otherwise(extra + F.floor((position - edge) / small)).cast("int")


def shard_sizes(total: int, shards: int) -> list[int]:
    small, extra = divmod(total, shards)
    return [small + (k < extra) for k in range(shards)]


class FeatureCacheWriter:
    def __init__(self, spark: SparkSession, path: str, settings: Settings) -> None:
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    def write(self, df: DataFrame, column: str, id_column: str) -> None:
        """Replace the cache by the rows of df; ids must be 0..n-1 (see `numbered`)."""
        n = self.check(df, column, 0, id_column)
        commit = self.store(df, column, id_column, n)
        self.publish(n, shard_sizes(n, self.settings.num_shards), [commit])
        sweep(self.spark, self.path, [commit])

    def append(self, df: DataFrame, column: str, id_column: str) -> None:
        """Add rows whose ids go on from the stored ones; one shard only."""
        meta = read_meta(self.spark, self.path)
        own = asdict(self.settings)
        for key in ("dim", "group_size", "mode", "num_shards", "seq_len"):
            if meta[key] != own[key]:
                raise ValueError(f"{key} is {meta[key]} in the cache, not {own[key]}")
        if meta["num_shards"] != 1:
            raise ValueError("only a cache of one shard can grow")
        n = self.check(df, column, meta["num_samples"], id_column)
        commit = self.store(df, column, id_column, None)
        self.publish(meta["num_samples"] + n, [meta["num_samples"] + n], [*meta["commits"], commit])

    def check(self, df: DataFrame, column: str, start: int, id_column: str) -> int:
        got = df.agg(F.count(F.lit(1)).alias("n"), F.count(id_column).alias("k"), F.min(id_column).alias("a"), F.max(id_column).alias("z"), F.max((F.size(column) != self.settings.width).cast("int")).alias("bad")).first()
        if got.n and (got.k != got.n or got.a != start or got.z != start + got.n - 1 or df.groupBy(id_column).count().where("count > 1").limit(1).count()):
            raise ValueError(f"ids must run from {start} without gaps or repeats")
        if got.bad:
            raise ValueError(f"every sample must have {self.settings.width} values")
        return got.n

    def store(self, df: DataFrame, column: str, id_column: str, n: int | None) -> str:
        """Write the rows, dealt by shard so that each gets few files; n is their number where they fill all shards."""
        commit = uuid.uuid4().hex
        coded = Q.encode(df.select(F.col(id_column).cast("long").alias("sample_id"), F.col(column)), column, self.settings.mode, self.settings.group_size)
        shard = shard_of(F.col("sample_id"), n, self.settings.num_shards) if n else F.lit(0)
        rows = P.store(coded.select("sample_id", "code"), self.settings.mode).withColumn("shard", shard)
        rows.repartitionByRange("shard", "sample_id").sortWithinPartitions("shard", "sample_id").write.partitionBy("shard").parquet(f"{self.path}/data/commit={commit}")
        return commit

    def publish(self, n: int, sizes: list[int], commits: list[str]) -> None:
        s = self.settings
        publish(self.spark, self.path, (n, s.dim, s.group_size, s.mode, s.num_shards, sizes, s.seq_len, commits), META)


def numbered(df: DataFrame, order: str, name: str = "sample_id") -> DataFrame:
    """df with positions 0..n-1 by `order`: partition counts and a place in each range partition, no single task."""
    # settled, as two uses of a range partitioning may sample different bounds
    p = settled(df.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id()))
    counts = p.groupBy("__p").count()
    before = counts.select(F.col("__p").alias("__q"), F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return p.withColumn("__o", own).join(before, F.col("__p") == F.col("__q")).withColumn(name, (F.col("__b") + F.col("__o")).cast("long")).drop("__p", "__q", "__b", "__o")


def read_meta(spark: SparkSession, path: str) -> dict:
    return newest(spark, path, META)


class FeatureCacheDataset:
    """Scans, point lookups and batches over a cache; a shard or a rank of several readers selects partitions."""

    def __init__(self, spark: SparkSession, path: str, shard_idx: int | None = None, rank: int | None = None, world_size: int | None = None) -> None:
        self.spark, self.path, self.meta = spark, path.rstrip("/"), read_meta(spark, path)
        shards = self.meta["num_shards"]
        if rank is not None and not 0 <= rank < (world_size or shards):
            raise ValueError("rank must be in [0, world_size)")
        self.shard = shard_idx if shard_idx is not None else rank % shards if rank is not None else None
        if self.shard is not None and not 0 <= self.shard < shards:
            raise ValueError(f"shard {self.shard} of {shards}")

    def __len__(self) -> int:
        return self.meta["num_samples"] if self.shard is None else self.meta["shard_sizes"][self.shard]

    @property
    def width(self) -> int:
        return self.meta["seq_len"] * self.meta["dim"]

    def codes(self) -> DataFrame:
        """(sample_id, q, scale_bits, zp, shard), packed."""
        at = [f"{self.path}/data/commit={c}" for c in self.meta["commits"]]
        df = self.spark.read.schema(f"{DATA}, shard int, commit string").option("basePath", f"{self.path}/data").parquet(*at).drop("commit")
        return df if self.shard is None else df.where(F.col("shard") == self.shard)

    def load(self, df: DataFrame) -> DataFrame:
        return P.load(df, self.meta["mode"], self.width, self.meta["group_size"])

    def decoded(self) -> DataFrame:
        return self.load(self.codes()).select("sample_id", "shard", "decoded")

    def tokens(self) -> DataFrame:
        """(sample_id, token, decoded): one row for each of a sample's seq_len vectors."""
        dim = self.meta["dim"]
        parts = F.transform(F.sequence(F.lit(0), F.lit(self.meta["seq_len"] - 1)), lambda t: F.slice("decoded", t * dim + 1, F.lit(dim)))
        return self.decoded().select("sample_id", F.posexplode(parts).alias("token", "decoded"))

    def get(self, i: int, decode: bool = True) -> DataFrame:
        """One sample; negative numbers count from the end. The shard is computed, so one partition is read."""
        n = self.meta["num_samples"]
        i = i + n if i < 0 else i
        if not 0 <= i < n:
            raise IndexError(i)
        at, shard = 0, 0
        for shard, size in enumerate(self.meta["shard_sizes"]):
            if i < at + size:
                break
            at += size
        df = self.codes().where((F.col("shard") == shard) & (F.col("sample_id") == i))
        return self.load(df) if decode else df

    def gather(self, ids: DataFrame) -> DataFrame:
        """Samples whose sample_id is in ids; they are picked while packed."""
        return self.load(self.codes().join(ids.select("sample_id").distinct(), "sample_id", "left_semi"))

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        """n samples without replacement, those of smallest seeded hash."""
        ids = self.codes().select("sample_id").orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id").limit(n)
        return self.gather(ids)

    def batches(self, batch_size: int = 128, shuffle: bool = False, seed: int = 0, drop_last: bool = False) -> DataFrame:
        """decoded() with batch_id. Unshuffled batches are arithmetic on ids; shuffled ones number the rows by a seeded hash."""
        df = self.decoded()
        if shuffle:
            df = numbered(df.withColumn("__k", F.xxhash64("sample_id", F.lit(seed))), "__k", "__n").drop("__k")
        else:
            df = df.withColumn("__n", F.col("sample_id") - (0 if self.shard is None else sum(self.meta["shard_sizes"][: self.shard])))
        df = df.withColumn("batch_id", F.floor(F.col("__n") / batch_size))
        return (df.where(F.col("batch_id") < len(self) // batch_size) if drop_last else df).drop("__n")

    def iter_batches(self, batch_size: int = 128, **kw) -> Iterator[list]:
        """Batches on the driver, partitions fetched one ahead; memory holds two partitions."""
        held, batch = [], None
        for row in self.batches(batch_size, **kw).orderBy("batch_id", "sample_id").toLocalIterator(prefetchPartitions=True):
            if batch is not None and row.batch_id != batch:
                yield held
                held = []
            held.append(row)
            batch = row.batch_id
        if held:
            yield held

    def info(self) -> dict:
        files = [self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.path}/data/commit={c}") for c in self.meta["commits"]]
        size = sum(f.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] for f in files)
        stored = self.codes().agg(F.sum(F.octet_length("q") + 2 * F.size("scale_bits") + F.coalesce(F.octet_length("zp"), F.lit(0)))).first()[0]
        per = Q.bytes_per_value(self.meta["mode"], self.meta["group_size"])
        return self.meta | {"file_bytes": size, "bytes_per_value": per, "stored_bytes_per_value": (stored or 0) / max(1, len(self) * self.width)}
