"""Sharding: minimax contiguous partition of ordered atomic groups.

Documents are ordered by a hash of their text; texts whose hashes share the first HASH_BITS bits
form an atomic group, so equal texts are always together and the number of groups has a bound that
does not depend on the data. The driver gets one size per atomic group, binary-searches the least
capacity for which greedy filling needs no more shards than asked for, and cuts there. Only a group
larger than an equal share is divided (by document id), as no partition could be near equal
otherwise.

Law: `bytes`. Defined results: a null text has no bytes (its size is the 16 of every document, its
checksum 0); repeated rows get slots of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import checkpoint

SHARDS = 40
OVERHEAD = 16
HASH_BITS = 16
#: A group with more than 1/PIECES of the documents (and more than PIECE_ROWS) is handled in pieces.
PIECES, PIECE_ROWS = 1024, 128


def capacity(sizes: np.ndarray, shards: int) -> int:
    """Least capacity for which greedy filling of consecutive groups needs at most `shards` shards."""
    if not len(sizes):
        return 0
    ends = np.cumsum(sizes)
    total = int(ends[-1])

    def fits(cap: int) -> bool:
        done = 0
        for _ in range(shards):
            k = int(np.searchsorted(ends, done + cap, side="right"))
            if k == len(ends):
                return True
            done = int(ends[k - 1]) if k else 0
        return False

    low, high = max(int(sizes.max()), -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def cut(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each group: contiguous, no shard above the least capacity.

    Of the cuts that keep to the capacity, each is the one nearest to its equal share.
    """
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    cap, ends = capacity(sizes, shards), np.concatenate([[0], np.cumsum(sizes)])
    total, n = int(ends[-1]), len(sizes)
    least = [n]  # least[j]: the first group from which j shards can hold the rest
    for _ in range(shards):
        least.append(int(np.searchsorted(ends, ends[least[-1]] - cap, side="left")))
    out, start = np.zeros(n, dtype=np.int64), 0
    for k in range(1, shards + 1):
        most = int(np.searchsorted(ends, ends[start] + cap, side="right")) - 1
        want = k * total / shards
        at = int(np.searchsorted(ends, want))
        at = at if at <= n and (at == 0 or abs(ends[min(at, n)] - want) <= abs(ends[at - 1] - want)) else at - 1
        end = min(max(at, least[shards - k], start), most)
        out[start:end] = k - 1
        start = end
    return out


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    narrow = checkpoint(docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - HASH_BITS).cast("int").alias("atom"),
    ))
    groups = narrow.groupBy("atom").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 2 ** HASH_BITS rows
    piece = max(PIECE_ROWS, -(-int(groups["n"].sum()) // PIECES))
    hot = groups[groups["n"] > piece]
    hot_rows = [(int(a), -(-int(n) // piece)) for a, n in zip(hot["atom"], hot["n"], strict=True)]  # at most PIECES rows
    pieces = spark.createDataFrame(hot_rows, "atom int, k int")
    split = narrow.join(F.broadcast(pieces), "atom", "left")
    split = split.withColumn("piece", F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("k")).cast("int"))).drop("k")
    sizes = split.groupBy("atom", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toPandas().sort_values(["atom", "piece"])  # at most 2 ** HASH_BITS + 2 * PIECES rows
    whole = sizes.groupby("atom")["bytes"].transform("sum").to_numpy()
    own = whole > max(1, sizes["bytes"].sum()) / shards  # a group above an equal share goes piece by piece
    first = np.ones(len(sizes), dtype=bool)
    first[1:] = (sizes["atom"].to_numpy()[1:] != sizes["atom"].to_numpy()[:-1]) | own[1:]
    unit = np.cumsum(first) - 1
    sizes["shard"] = cut(np.bincount(unit, weights=sizes["bytes"]).astype(np.int64), shards)[unit] if len(sizes) else []
    sizes["before"] = sizes.groupby("shard")["n"].cumsum() - sizes["n"]
    rows = [tuple(map(int, r)) for r in sizes[["atom", "piece", "shard", "before"]].itertuples(index=False)]
    places = spark.createDataFrame(rows, "atom int, piece int, shard int, before long")
    slot = F.row_number().over(Window.partitionBy("atom", "piece").orderBy("doc_id", "text_crc32", "size")) - 1
    return split.withColumn("own", slot).join(F.broadcast(places), ["atom", "piece"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"))


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The columns of op8."""
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
