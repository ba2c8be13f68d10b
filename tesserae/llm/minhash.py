"""MinHash near-dedup by chosen-path similarity join.

1. Each text becomes its set of hashed word shingles; equal sets form a class, whose smallest id
   stands for it. The set gets SIGNATURE minwise values.
2. TREES independent trees branch the documents: a node chooses one coordinate of the signature, and
   a second with probability 1/similarity - 1, and a document goes on to the child named by its own
   minwise value there, so that a pair at the threshold meets in 1 child on average or more. Nodes
   of up to LEAF documents are compared exhaustively by signature; larger ones branch on, up to
   DEPTH levels. What is still large then (copies of one text, mostly) is connected in blocks of
   BLOCK documents (`cells.connect`), so nothing is capped.
3. Signature matches, with a margin for the sketch's error, join documents into candidate groups.
   Only their texts are read again, once; in each group links are confirmed on the full shingle
   sets, all pairs but those already connected, large groups in blocks again.
4. Links are contracted to components by star contraction.

A pair at the threshold is missed by one tree with a probability of 0.13 (leaf at depth 1) to 0.4
(depth 4), by all with at most 0.4 ** TREES.

Defined results: null, empty and blank texts have the empty set and link with nothing; a text with
fewer words than a shingle has one element, the whole sequence; very long texts are hashed as a
whole, in arrays of their own; rows with a null id link with nothing; rows that repeat an id count
as one document that holds the links of each; of equal or tied documents the smallest id stands for
the group; an empty table gives an empty one; other columns, of whatever name, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.cells import connect
from tesserae.llm.common import TASK_ROWS, checkpoint, components, few, packed, spread_join, stored

SIGNATURE, TREES, DEPTH, LEAF, BLOCK = 128, 6, 4, 128, 2048
#: Bytes of shingle sets of a candidate group that one task compares; groups with more are connected in blocks.
BLOCK_BYTES = 8 << 20
#: Rows of nodes (three numbers each), and of ids with signatures, that are worth a task and a file of their own.
NODE_ROWS, SIG_ROWS = 5 * TASK_ROWS, TASK_ROWS
#: Bytes of text hashed together.
GATHER = 1 << 18
SPREAD = 3.5  # standard deviations of the sketch's error that still make a candidate
M1, M2, STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def fmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x = x ^ (x >> np.uint64(33))
    x = x * M2
    return x ^ (x >> np.uint64(33))


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte is white space, and its random number (0 for white space; equal for A-Z and a-z)."""
    space = np.zeros(256, dtype=bool)
    space[[32, *range(9, 14)]] = True
    value = np.random.default_rng(11).integers(1, 1 << 64, 256, dtype=np.uint64)
    value[65:91] = value[97:123]
    value[space] = 0
    return space, value


SPACE, VALUE = byte_tables()
BASE = np.uint64(0x2545F4914F6CDD1D)


def powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), BASE, dtype=np.uint64))])


def word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts that stand in data one after another (text k begins at begins[k]), and where each word starts."""
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    begins = begins[begins < len(data)]
    first[begins] = ~space[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    run = np.diff(np.append(starts, len(data)))  # a word and the white space after it, which adds nothing
    power = powers(int(run.max()))
    out = np.empty(len(starts), dtype=np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), GATHER)), len(starts)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own, end = starts[a:b], starts[a] + run[a:b].sum()
        place = np.arange(starts[a], end) - np.repeat(own, run[a:b])
        out[a:b] = np.add.reduceat(VALUE[data[starts[a]:end]] * power[place], own - starts[a])
    return fmix(out), starts


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; text i is data[ends[i-1]:ends[i]]."""
    h, starts = word_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64))
    upto = np.searchsorted(starts, ends, side="left")
    out = np.full(max(0, len(h) - k + 1), k, dtype=np.uint64) * STEP
    for j in range(k if len(out) else 0):
        out = (out + h[j:len(h) - k + 1 + j]) * M1
    out = fmix(out)
    sets = []
    for a, b in zip(np.concatenate([[0], upto[:-1]]).tolist(), upto.tolist(), strict=True):
        if b - a >= k:
            own = np.sort(out[a:b - k + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:  # fewer words than a shingle: the whole sequence
            one = np.full(1, b - a, dtype=np.uint64) * STEP
            for x in h[a:b]:
                one = (one + x) * M1
            sets.append(fmix(one))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def sets_of(text: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets of the rows from there on), about GATHER bytes of text at a time; null counts as empty."""
    text = text.fill_null("")
    start = 0
    width = pa.compute.binary_length(text).to_numpy()
    upto = np.cumsum(width)
    while start < len(text):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + GATHER, side="right")))
        own = text.slice(start, end - start)
        kind, size = (np.int64, 8) if pa.types.is_large_string(own.type) else (np.int32, 4)
        at = np.frombuffer(own.buffers()[1], kind, len(own) + 1, own.offset * size).astype(np.int64)
        data = np.frombuffer(own.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
        yield start, shingle_sets(data, at[1:] - at[0], k)
        start = end


def shingle_set(text: str | None, k: int) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    return shingle_sets(np.frombuffer(data, np.uint8), np.array([len(data)]), k)[0]


def coordinates(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 31, SIGNATURE, dtype=np.uint32) << np.uint32(1)) | np.uint32(1), rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), SIGNATURE) minwise values; sets must not be empty."""
    a, b = coordinates()
    out = np.empty((len(sets), SIGNATURE), dtype=np.uint32)
    lens = np.array([len(s) for s in sets])
    start = 0
    while start < len(sets):
        total = np.cumsum(lens[start:])
        end = start + max(1, int(np.searchsorted(total, 32_768, side="right")))
        x = (np.concatenate(sets[start:end]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum(lens[start:end])[:-1]])
        for i in range(SIGNATURE):
            out[start:end, i] = np.minimum.reduceat((x ^ b[i]) * a[i], at)
        start = end
    return out


def features(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, digest, sig): set size, 128-bit digest of the set and signature; both null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, sets in sets_of(whole.column(1), k):
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full)) if full else iter(())
                yield pa.record_batch({
                    "doc_id": whole.column(0).slice(at, len(sets)), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
                    "sig": pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, digest binary, sig binary")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, SIGNATURE)


def children(node: np.ndarray, sig: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes, one or two for each row."""
    pick = lambda salt: fmix(node ^ np.uint64(salt) * STEP)
    c0, c1 = pick(1) % np.uint64(SIGNATURE), pick(2) % np.uint64(SIGNATURE)
    two = ((pick(3) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < 1 / similarity - 1) & (c0 != c1)
    rows = np.concatenate([np.arange(len(node)), np.flatnonzero(two)])
    c = np.concatenate([c0, c1[two]])
    value = sig[rows, c.astype(np.int64)].astype(np.uint64)
    return rows, fmix(fmix(node[rows] + c * STEP) ^ (value * M2))


def branch(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, doc_id) one level down from (node, doc_id, sig); at the root node is the tree's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, child = children(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), matrix(b.column(2)), similarity)
                yield pa.record_batch({"node": pa.array(child.view(np.int64)), "doc_id": b.column(1).take(pa.array(rows))})

    return nodes.select("node", "doc_id", "sig").mapInArrow(run, "node long, doc_id long")


def sketch_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect what matches by signature within each node of rows (node, id, size, sig)."""
    least = SIGNATURE * (similarity - SPREAD * (similarity * (1 - similarity) / SIGNATURE) ** 0.5)

    def links(cell: pa.Table):
        sig = matrix(cell.column("payload"))
        return lambda i, js: (sig[js] == sig[i]).sum(1) >= least

    return connect(rows.select("node", "id", F.lit(1).alias("weight"), F.col("size").alias("total"), F.col("sig").alias("payload")), BLOCK, links, pairwise=True)


def candidates(reps: DataFrame, similarity: float, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """Links between documents that some tree brings together and whose signatures match. reps: (doc_id, sig)."""
    roots = F.explode(F.array(*[F.lit(t).cast("long") for t in range(1, trees + 1)]))
    nodes = branch(reps.select(roots.alias("node"), "doc_id", "sig"), similarity)
    leaves, rows = None, trees * reps.count()
    for level in range(1, depth + 1):
        nodes = packed(checkpoint(few(nodes, rows, NODE_ROWS)), rows)
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = packed(checkpoint(few(spread_join(nodes, sizes, "node", rows=rows), rows, NODE_ROWS)), rows)
        end = level == depth
        done = met if end else met.where(F.col("size") <= leaf)
        leaves = done if leaves is None else leaves.unionByName(done)
        if end or not met.where(F.col("size") > leaf).limit(1).count():
            break
        nodes = branch(met.where(F.col("size") > leaf).join(reps, "doc_id"), similarity)
    leaves = packed(checkpoint(few(leaves.select("node", "doc_id", "size").distinct(), rows, NODE_ROWS)), rows)
    return sketch_links(leaves.join(reps, "doc_id").withColumnRenamed("doc_id", "id"), similarity)


def confirmed(docs: DataFrame, groups: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect what links by full shingle sets within each group (id, component)."""
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, sets in sets_of(whole.column(2), k):
                yield pa.record_batch({
                    "node": whole.column(0).slice(at, len(sets)), "id": whole.column(1).slice(at, len(sets)),
                    "weight": pa.array([8 * len(s) for s in sets], pa.int64()), "payload": pa.array([s.tobytes() for s in sets], pa.binary()),
                })

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(groups, F.col("doc_id") == F.col("id")).select("component", "id", "text")
    sets = stored(texts.mapInArrow(run, "node long, id long, weight long, payload binary").where("weight > 0"), "candidates")
    totals = sets.groupBy("node").agg(F.sum("weight").alias("total"))

    def links(cell: pa.Table):
        payload = cell.column("payload").combine_chunks()
        at = np.frombuffer(payload.buffers()[1], np.int32, len(payload) + 1, 4 * payload.offset).astype(np.int64)
        every, at = np.frombuffer(payload.buffers()[2], np.uint64, int(at[-1]) // 8), at // 8
        size = np.diff(at)

        def linked(i: int, js: np.ndarray) -> np.ndarray:
            own = every[at[i]:at[i + 1]]
            ok = 100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])
            near = np.flatnonzero(ok)
            for c in range(0, len(near), 256):
                j = js[near[c:c + 256]]
                x = np.concatenate([every[at[r]:at[r + 1]] for r in j])
                pos = np.minimum(np.searchsorted(own, x), size[i] - 1)
                both = np.add.reduceat((own[pos] == x).astype(np.int64), np.concatenate([[0], np.cumsum(size[j])[:-1]]))
                ok[near[c:c + 256]] = 100 * both >= percent * (size[j] + size[i] - both)
            return ok

        return linked

    return connect(spread_join(sets, totals, "node"), BLOCK_BYTES, links)


def dedup(docs: DataFrame, k: int = 5, similarity: float = 0.8, trees: int = TREES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs."""
    f = stored(features(docs, k), "features")
    n = f.count()
    classes = checkpoint(few(f.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), n, NODE_ROWS))
    reps = f.select("doc_id", "digest", "sig").join(classes.withColumnRenamed("digest", "rdigest"), (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("rdigest")))
    reps = stored(few(reps.select("doc_id", "sig").dropDuplicates(["doc_id", "sig"]), n, SIG_ROWS), "reps")
    groups = stored(few(components(candidates(reps, similarity, trees)), n, NODE_ROWS), "groups")
    links = components(confirmed(docs, groups, k, similarity))
    classes = classes.join(links, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = spread_join(f.select("doc_id", "n", "digest"), classes, "digest", "left").withColumn("component", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))
    return few(out, n)


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8, trees: int = TREES) -> DataFrame:
    """The rows of docs whose id is the smallest of their group, once each (rows with a null id stay).

    Texts are
    shuffled once, and not sorted.
    """
    judged = checkpoint(dedup(docs, k, similarity, trees).select("doc_id", "kept"))
    out = stored(judged.where("not kept and doc_id is not null").select(F.col("doc_id").alias("mh_id")).distinct(), "dropped")
    again = stored(judged.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("mh_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mh_id"), "again")
    whole = docs.join(out.hint("shuffle_hash"), F.col("doc_id") == F.col("mh_id"), "left_anti")
    if again.limit(1).count():  # rows that repeat an id: the first by the hash of its text
        rows = whole.join(again, F.col("doc_id") == F.col("mh_id")).withColumn("mh_r", F.row_number().over(Window.partitionBy("mh_id").orderBy(F.xxhash64("text")))).where("mh_r = 1")
        whole = whole.join(again, F.col("doc_id") == F.col("mh_id"), "left_anti").unionByName(rows.select(*docs.columns))
    return whole


def report(docs: DataFrame) -> DataFrame:
    """The columns of op2."""
    return dedup(docs, k=3, similarity=0.85)


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * inter >= 85 * (x.n + y.n - inter)
), r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a
), m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
