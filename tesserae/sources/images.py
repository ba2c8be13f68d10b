"""Image ingest: directories of image files, or byte columns cut into tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import wavelet as W
from tesserae.operators.arrow import arrow_schema

IMAGE = "id long, height int, width int, channels int, data binary"
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")


def read_directory(spark: SparkSession, path: str, height: int, width: int, channels: int = 3, limit: int | None = None, extensions: tuple[str, ...] = EXTENSIONS, skip_invalid: bool = False) -> DataFrame:
    """Images below a directory in path order, resized; ids are 0, 1, ... Colour files are refused for one channel.

    Files that can't be decoded (Spark reads no webp) raise an error that names them, or, with
    skip_invalid, are left out; `invalid_files` lists them.
    """
    files = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(e for x in extensions for e in (x, x.upper())) + "}").load(path)
    rows = files.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    if skip_invalid:
        rows = rows.where("height > 0")
    if limit is not None:
        rows = rows.orderBy("origin").limit(limit)

    schema = "origin string, height int, width int, channels int, data binary"
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["height"] <= 0:
                    raise ValueError(f"{r['origin']} can't be decoded")
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                a = a[..., :3][..., ::-1] if r["nChannels"] >= 3 else a  # stored as BGR
                if channels == 1 and a.shape[2] == 3:
                    raise ValueError(f"{r['origin']} has colour, one channel was asked for")
                a = np.repeat(a, 3, 2) if channels == 3 and a.shape[2] == 1 else a
                yield pa.RecordBatch.from_pylist([{"origin": r["origin"], "height": height, "width": width, "channels": channels, "data": W.resize(a, height, width).tobytes()}], types)

    from tesserae.sources.feature_cache import numbered

    return numbered(rows.mapInArrow(run, schema), "origin", "id").select("id", "height", "width", "channels", "data")


def invalid_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(origin) of image files below a directory that can't be decoded."""
    files = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(e for x in extensions for e in (x, x.upper())) + "}").load(path)
    return files.where("image.height <= 0").select("image.origin")


def tiles(df: DataFrame, key: str, payload: Column, side: int = 16) -> DataFrame:
    """(key, tile, height, width, channels, data): all bytes of each payload in RGB tiles, the last padded with zeros."""
    size = side * side * 3
    p = F.coalesce(payload, F.lit("")).cast("binary")
    n = F.ceil(F.octet_length(p) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    # slices are taken before the explode, so each row carries its own bytes only
    parts = F.transform(starts, lambda i: F.struct(i.alias("i"), F.substr(p, i * size + 1, F.lit(size)).alias("d")))
    out = df.select(key, F.explode(parts).alias("t")).select(key, F.col("t.i").alias("tile"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(3).alias("channels"), F.col("t.d").alias("data"))
    return out.withColumn("data", F.when(F.octet_length("data") == size, F.col("data")).otherwise(F.rpad(F.col("data"), size, F.lit("\0").cast("binary"))))
