"""Fidelity and size measures as grouped aggregates over (x, r) value rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ranking import running


def diff() -> Column:
    return F.col("x") - F.col("r")


def sse() -> Column:
    return F.sum(diff() * diff())


def rel_rmse() -> Column:
    """Percent of the signal's norm."""
    return F.when(F.sum(F.col("x") * F.col("x")) > 0, 100.0 * F.sqrt(sse()) / F.sqrt(F.sum(F.col("x") * F.col("x")))).otherwise(F.lit(0.0))


def mape() -> Column:
    return 100.0 * F.avg(F.abs(diff())) / (F.avg(F.abs("x")) + 1e-12)


def psnr(peak: Column | None = None) -> Column:
    """20 log10(peak / rms error), infinite without error; the peak is the data's range unless given."""
    span = F.max("x") - F.min("x") if peak is None else peak
    mse = F.avg(diff() * diff())
    return F.when(mse > 0, 20.0 * F.log10(span / F.sqrt(mse))).otherwise(F.lit(float("inf")))


def cosine() -> Column:
    return F.least(F.lit(1.0), F.sum(F.col("x") * F.col("r")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("r") * F.col("r"))))


def tensor_metrics(values: DataFrame, *by: str) -> DataFrame:
    return values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rel_rmse().alias("rel_rmse"), mape().alias("mape"), F.max(F.abs(diff())).alias("max_err"), psnr().alias("psnr"), cosine().alias("cos_sim"))


def outlier_error(values: DataFrame, share: float, *by: str) -> DataFrame:
    """Relative error on the `share` of values of greatest magnitude in each group, one at least.

    The threshold comes from exact counts by magnitude, added up through range partitions (no group
    is sorted in one task); values equal to it count in proportion, so that ties need no order.
    """
    mags = values.groupBy(*by, F.abs("x").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(diff())).alias("e"))
    k = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(share))).cast("long")
    top = running(mags, list(by), [F.desc("m")], "n").withColumn("k", k).where("before < k")
    part = F.least(F.col("n"), F.col("k") - F.col("before")) / F.col("n")
    return top.groupBy(*by).agg(F.sum(F.least(F.col("n"), F.col("k") - F.col("before"))).alias("k"), (100.0 * F.sum(F.col("e") * part) / (F.sum(F.col("m") * F.col("n") * part) + 1e-12)).alias("outlier_err"))


def ssim(*, x: str = "x", r: str = "r", peak: float = 255.0) -> Column:
    """Structural similarity over a whole group (no windows)."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    mx, mr = F.avg(x), F.avg(r)
    return ((2 * mx * mr + c1) * (2 * F.covar_pop(x, r) + c2)) / ((mx * mx + mr * mr + c1) * (F.var_pop(x) + F.var_pop(r) + c2))


def estimate(numel: int, group: int = 32, affine: bool = True) -> dict[str, float]:
    """Sizes without quantizing; the total counts the scales of a short last block in full."""
    n_blocks = -(-numel // group)
    per = 1 + (3 if affine else 2) / group
    return {"numel": numel, "num_blocks": n_blocks, "bytes_per_elem": per, "total_bytes": numel + n_blocks * (3 if affine else 2), "ratio_vs_bf16": 2 / per, "ratio_vs_fp32": 4 / per}
