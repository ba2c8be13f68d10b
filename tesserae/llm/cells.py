"""Whole groups streamed through Python: rows sorted by a cell number, cut at its changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import checkpoint, spread_join


def map_cells(df: DataFrame, cell: str, fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Deal rows by `cell` (long, not null) and hand fn tables of whole cells with the row numbers where they start.

    Memory holds one Arrow batch and one cell, so callers bound the size of a cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts)
            if whole.num_rows:
                ids = whole.column(cell).to_numpy()
                starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
                yield from fn(whole, starts)

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(cell).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(ids, ids[-1], side="left"))  # sorted: the last cell may go on
            if cut == 0 and (last is None or last == ids[-1]):
                held.append(b)
            else:
                yield from flush([*held, b.slice(0, cut)])
                held = [b.slice(cut)]
            last = ids[-1]
        if held:
            yield from flush(held)

    return df.repartition(cell).sortWithinPartitions(cell).mapInArrow(run, schema)


def joined(n: int, linked: Callable[[int, np.ndarray], np.ndarray], label: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """A number for each of 0..n-1, equal for those connected by equal labels and links.

    linked(i, js) tells which of js item i links with. Every pair (of different sides only, if sides
    are given) is compared but those already known to be connected.
    """
    of = np.unique(label, return_inverse=True)[1]
    out, rest, k = np.empty(n, dtype=np.int64), np.arange(n), 0
    while len(rest):
        own = of[rest] == of[rest[0]]
        queue, rest = rest[own].tolist(), rest[~own]
        out[queue] = k
        while queue and len(rest):
            i = queue.pop()
            js = rest if side is None else rest[side[rest] != side[i]]
            hit = js[linked(i, js)] if len(js) else js
            if len(hit):
                own = np.isin(of[rest], of[hit])
                new, rest = rest[own], rest[~own]
                out[new] = k
                queue += new.tolist()
        k += 1
    return out


Links = Callable[[pa.Table], Callable[[int | np.ndarray, np.ndarray], np.ndarray]]


def connect(rows: DataFrame, limit: int, links: Links, pairwise: bool = False) -> DataFrame:
    """Links (a, b) that connect, in each group, all that links there; rows (node, id, weight, total, payload), read again only for groups above the limit; total is the group's weight.

    links(table) gives the test for rows by their numbers in it, test(i, js); with `pairwise` it takes as
    many i as js, too. A group of weight up to `limit` is one cell.
    A larger one is dealt into blocks that are connected within; then only one row of each part met
    so far is compared across blocks; and what still stands apart from the group's largest part
    meets, block by block, the rest. So no pair that may add a connection is left out, and a group
    of near copies costs about as many comparisons as it has rows.
    """
    blocks = lambda total: F.greatest(F.ceil(total / limit), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    links_of = lambda df: df.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    first = rows.withColumn("blocks", blocks(F.col("total"))).withColumn("mine", mine).withColumn("label", F.col("id"))
    first = checkpoint(parts(first.withColumn("cell", F.xxhash64("node", "mine")).withColumn("side", F.lit(0)), links, pairwise))
    edges, own = links_of(first), rows.where(F.col("total") > limit)
    if not own.limit(1).count():
        return edges
    # one row of each part, block against block
    several = first.where("blocks > 1").select("node", "id", "label")
    heads = checkpoint(own.drop("total").join(several.where("id = label").select("node", "id"), ["node", "id"]))
    across = spread_join(heads, heads.groupBy("node").agg(F.sum("weight").alias("total")), "node").withColumn("blocks", blocks(F.col("total"))).withColumn("mine", mine)
    across = across.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    across = across.withColumn("cell", F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other"))).withColumn("side", F.col("mine")).withColumn("label", F.col("id"))
    across = checkpoint(parts(across, links, pairwise))
    edges = edges.unionByName(links_of(across))
    # rows of one label are connected; labels may still be parts of one component, which only costs comparisons
    up = across.groupBy("node", F.col("id").alias("label")).agg(F.min("label").alias("up"))
    label = several.join(up, ["node", "label"], "left").select("node", "id", F.coalesce("up", "label").alias("label"))
    own = checkpoint(own.join(label, ["node", "id"]))
    main = own.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    minor = checkpoint(spread_join(own, main, "node").where("label <> main").drop("main"))
    few = checkpoint(minor.groupBy("node").agg(blocks(F.sum("weight")).alias("probes")))
    if not few.limit(1).count():
        return edges
    dealt = lambda df: spread_join(df, few, "node").withColumn("blocks", blocks(F.col("total"))).withColumn("mine", mine)
    probes = dealt(minor).withColumn("p", F.pmod(F.xxhash64("id", F.lit(8)), F.col("probes")).cast("int"))
    probes = probes.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    meet = dealt(own).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("probes") - 1))).withColumn("q", F.col("mine")).withColumn("side", F.lit(1))
    last = parts(probes.unionByName(meet.select(probes.columns)).withColumn("cell", F.xxhash64("node", "p", "q")), links, pairwise)
    return edges.unionByName(links_of(checkpoint(last)))


def parts(rows: DataFrame, links: Links, pairwise: bool) -> DataFrame:
    """(node, id, label, blocks): the least id connected to each within its cell; rows (cell, node, id, side, label, blocks, payload).

    Rows of one side are compared unless the cell holds two. Rows that connect with nothing are left
    out, but for those of groups with several blocks.
    """

    def run(whole: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, ids, label, blocks, side = (whole.column(c).to_numpy() for c in ("node", "id", "label", "blocks", "side"))
        least, test = ids.copy(), links(whole)
        ends = np.append(starts[1:], len(ids))
        todo = ends - starts > 1
        if pairwise:  # cells of two rows, which are most, at once
            two = starts[(ends - starts == 2)]
            hit = two[test(two, two + 1) | (label[two] == label[two + 1])]
            least[hit] = least[hit + 1] = np.minimum(ids[hit], ids[hit + 1])
            todo = ends - starts > 2
        for s, e in zip(starts[todo].tolist(), ends[todo].tolist(), strict=True):
            two = side[s:e].min() != side[s:e].max()
            part = joined(e - s, lambda i, js, s=s: test(s + i, s + js), label[s:e], side[s:e] if two else None)
            low = np.full(part.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, part, ids[s:e])
            least[s:e] = low[part]
        out = (least != ids) | (blocks > 1)
        yield pa.record_batch({"node": pa.array(node[out]), "id": pa.array(ids[out]), "label": pa.array(least[out]), "blocks": pa.array(blocks[out])})

    return map_cells(rows.select("cell", "node", "id", "side", "label", "blocks", "payload"), "cell", run, "node long, id long, label long, blocks int")
