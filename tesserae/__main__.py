"""Command line: info, benchmark, cache-info, compress-demo, help."""

from __future__ import annotations

import argparse
import json
import sys
import time

import tesserae
from tesserae.functions.search import PRESETS
from tesserae.functions.wavelet import PRESETS as PIXEL_PRESETS


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tesserae").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sample(spark, shape: str):
    """Pseudo-normal vectors of a shape such as 16x768 (rows x values)."""
    from pyspark.sql import functions as F

    rows, dim = (int(x) for x in shape.lower().split("x"))
    return spark.range(rows).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.sqrt(-2 * F.log((F.pmod(F.xxhash64("id", k), F.lit(1 << 24)) + 1) / float(1 << 24))) * F.cos(2 * 3.141592653589793 * F.pmod(F.xxhash64(k, "id"), F.lit(1 << 24)) / float(1 << 24))).alias("x"))


def errors(spark, df, mode: str, group: int) -> float:
    from pyspark.sql import functions as F

    from tesserae.functions import numerics as N
    from tesserae.operators import quantize as Q

    c = Q.encode(df, "x", mode, group)
    x, r = Q.values("x"), Q.decode(F.col("code"))
    s = c.agg(F.sum(N.total(F.zip_with(x, r, lambda a, b: (a - b) * (a - b)))).alias("e"), F.sum(N.total(F.transform(x, lambda a: a * a))).alias("n")).first()
    return 100 * (s.e / s.n) ** 0.5


def columns(spark, path: str) -> list[str]:
    """Columns of a cache's metadata, which tell its kind."""
    from tesserae.sources.tables import versions

    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no cache at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/meta/v{max(found)}").columns


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tesserae", description=__doc__)
    p.add_argument("--version", action="version", version=f"tesserae {tesserae.__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("help", help="this text")
    sub.add_parser("info", help="versions and presets")
    b = sub.add_parser("benchmark", help="error and time of every mode")
    b.add_argument("--shape", default="64x768")
    b.add_argument("--group-size", type=int, default=32)
    b.add_argument("--quality", action="store_true", help="include the search over 16-bit scales")
    c = sub.add_parser("cache-info", help="metadata and sizes of a cache")
    c.add_argument("--prefix", required=True)
    d = sub.add_parser("compress-demo", help="one mode there and back")
    d.add_argument("--shape", default="16x768")
    d.add_argument("--mode", default="amo_balanced")
    d.add_argument("--group-size", type=int, default=32)
    a = p.parse_args(argv)
    if a.command == "help":
        p.print_help()
        return 0
    if a.command == "info":
        import pyspark

        print(json.dumps({"tesserae": tesserae.__version__, "pyspark": pyspark.__version__, "feature_presets": PRESETS, "pixel_presets": PIXEL_PRESETS}, indent=1))
        return 0
    spark = session()
    if a.command == "cache-info":
        from tesserae.sources.feature_cache import FeatureCacheDataset
        from tesserae.sources.pixel_cache import PixelCacheDataset

        kind = FeatureCacheDataset if "seq_len" in columns(spark, a.prefix) else PixelCacheDataset
        print(json.dumps(kind(spark, a.prefix).info(), indent=1))
        return 0
    from tesserae.operators.quantize import MODES, bytes_per_value

    df = sample(spark, a.shape).cache()
    modes = [a.mode] if a.command == "compress-demo" else [m for m in MODES if a.quality or m != "amo_quality"]
    for m in modes:
        t = time.perf_counter()
        e = errors(spark, df, m, a.group_size)
        print(f"{m:14s} rel_rmse {e:.4f} %  {bytes_per_value(m, a.group_size):.4f} bytes a value  {time.perf_counter() - t:.2f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
