import numpy as np
import pytest
from helpers import awkward, documents, many_partitions, near_components, prose, shingles

from tesserae.llm import embed_dedup, minhash
from tesserae.llm.common import components


def as_dict(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_dedup_is_exact(spark, k, percent):
    rows = awkward(7, 120)
    got = as_dict(minhash.dedup(documents(spark, rows), k, percent / 100), "doc_id")
    want = near_components([(r[0], r[1]) for r in rows], k, percent)
    assert {i: g["component_id"] for i, g in got.items()} == want
    assert all(g["n_shingles"] == len(shingles(r[1], k)) for r in rows for g in [got[r[0]]])
    assert all(g["kept"] == (g["component_id"] == i) for i, g in got.items())


def test_large_nodes_and_blocks(spark, monkeypatch):
    """Small limits put every group through branching, blocks and pairs of blocks."""
    import random

    r = random.Random(3)
    base = prose(r, 200).split(" ")
    rows = []
    for i in range(40):
        w = list(base)
        w[r.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(w), "en", "a", 0))
    rows += [(100 + i, prose(r, 80), "en", "a", 0) for i in range(10)]
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4000)
    docs = documents(spark, rows)
    f = minhash.features(docs, 3)
    assert minhash.candidates(f.select("doc_id", "sig"), 0.85, leaf=4).count() > 0
    got = as_dict(minhash.dedup(docs, 3, 0.85), "doc_id")
    assert {i: g["component_id"] for i, g in got.items()} == near_components([(x[0], x[1]) for x in rows], 3, 85)


def test_near_dedup_leaves_few_files(spark, monkeypatch):
    """Nodes, leaves, signatures and the result take a task for each core, whatever the shuffles have."""
    rows, n, wrote = awkward(7, 120), spark.sparkContext.defaultParallelism, {}
    store, compare = minhash.stored, minhash.sketch_links
    monkeypatch.setattr(minhash, "stored", lambda df, name: wrote.setdefault(name, store(df, name)))
    with many_partitions(spark) as files:

        def compared(*args):
            wrote["nodes"] = files()
            return compare(*args)

        monkeypatch.setattr(minhash, "sketch_links", compared)
        got = minhash.dedup(documents(spark, rows), 3, 0.85)
        assert 0 < wrote["nodes"] <= 4 * n  # classes, nodes twice, leaves
        assert all(len(wrote[name].inputFiles()) <= n for name in ("reps", "groups")) and got.rdd.getNumPartitions() <= n
        assert {r.doc_id: r.component_id for r in got.collect()} == near_components([(r[0], r[1]) for r in rows], 3, 85)


def test_near_dedup_edges(spark):
    assert minhash.dedup(documents(spark, [])).count() == 0
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (2, "A B C D E F", "en", "s", 1), (3, "", "en", "s", 1), (4, "", "en", "s", 1)]
    got = minhash.dedup(documents(spark, rows)).collect()
    assert len(got) == 6
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4)]
    kept = minhash.keep_one(documents(spark, rows).withColumnRenamed("n_chars", "component_id"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "component_id"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 100), (5, 5), (300, 299)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=0, n=300, d=48):
    r = np.random.default_rng(seed)
    rows = []
    centre = r.normal(size=(12, d))
    for i in range(n):
        x = centre[i % 12] + r.normal(size=d) * r.choice([0.15, 0.3, 1.5])
        rows.append((i, x.astype(np.float32).tolist(), int(i % 3) if i % 17 else None))
    rows += [(n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [float("nan")] * d, 1), (n + 3, [1.0, float("inf")] * (d // 2), 1), (n + 4, rows[4][1], rows[4][2]), (n + 5, rows[4][1], rows[4][2]), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (None, rows[4][1], rows[4][2]), (n + 8, [], 1), (n + 9, [None, 1.0], 1)]
    return rows


def brute_vectors(rows):
    ok = [(i, np.array(x, float), lab) for i, x, lab in rows if i is not None and x and lab is not None and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    links, root = {i: 0 for i, *_ in rows if i is not None}, {i: i for i, *_ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ok)):
        for b in range(a):
            (i, x, p), (j, y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                s, t = find(i), find(j)
                root[max(s, t)] = min(s, t)
    return {i: (links[i], find(i)) for i in root}


@pytest.mark.parametrize("block", [2048, 8])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = embed_dedup.dedup(df).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id is not None}
    want = brute_vectors(rows)
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.99 * there
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)


def test_embedding_recall():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = r.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    a, b = embed_dedup.hashes(x), embed_dedup.hashes(0.93 * x + np.sqrt(1 - 0.93**2) * g)
    meet = ((b == a[:, :, :1]).any(2) | (a == b[:, :, :1]).any(2)).any(1)
    assert meet.mean() > 0.99


def test_wide_vectors_and_clashing_names(spark):
    """Doubles that no 4-byte float holds, extra columns, and all links of a table at the exact threshold of equal vectors."""
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=20) if i % 2 else np.ones(20) + 1e-9 * r.normal(size=20)).tolist(), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as code", "3 as x", "4 as kept")
    got = {g.vec_id: (g.n_links, g.component_id) for g in embed_dedup.dedup(df).collect()}
    assert got == brute_vectors(rows) and got[0] == (29, 0)


def test_empty_vectors(spark):
    assert embed_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert embed_dedup.dedup(spark.createDataFrame([(1, None, None)], "vec_id long, embedding array<float>, label int")).first().kept
