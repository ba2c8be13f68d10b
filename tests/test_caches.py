import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import metrics as M
from tesserae.operators import quantize as Q
from tesserae.sources import feature_cache as C
from tesserae.sources import pixel_cache as P


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(0).normal(size=(23, 70)).astype(np.float32)
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<float>")


@pytest.mark.parametrize("mode", Q.MODES)
def test_modes(vectors, mode):
    rows = Q.decompress(Q.encode(vectors, "x", mode)).select("x", "decoded").collect()
    x, r = (np.array([row[k] for row in rows]) for k in range(2))
    assert 100 * np.sqrt(((x - r) ** 2).sum() / (x * x).sum()) < {"int7": 2, "int6": 3, "int5": 6, "int4": 10, "int3": 25}.get(mode, 1)


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1.0])], "id long, x array<float>")
    for mode in ("sym", "amo_balanced"):
        got = {r.id: r.code for r in Q.encode(df, "x", mode).select("id", "code").collect()}
        assert got[1] is None and got[2] == [] and len(got[3][0].q) == 1
    with pytest.raises(ValueError):
        Q.encode(df, "x", "none")


def test_feature_cache(spark, vectors, tmp_path):
    at = f"file://{tmp_path}/c"
    C.FeatureCacheWriter(spark, at, C.Settings(70, 32, "amo_balanced", 4)).write(vectors, "x", "id")
    c = C.FeatureCacheDataset(spark, at)
    assert len(c) == 23 and c.meta["shard_sizes"] == [6, 6, 6, 5]
    assert c.get(-1).first().sample_id == 22
    assert [len(C.FeatureCacheDataset(spark, at, rank=r, world_size=4)) for r in range(4)] == [6, 6, 6, 5]
    assert [len(b) for b in c.iter_batches(10)] == [10, 10, 3]
    assert sorted(r.sample_id for b in c.iter_batches(10, shuffle=True, seed=1) for r in b) == list(range(23))
    assert c.info()["file_bytes"] > 0
    with pytest.raises(IndexError):
        c.get(23)
    with pytest.raises(ValueError):
        C.FeatureCacheWriter(spark, at, C.Settings(70, 32, "amo_fast", 4)).append(vectors, "x", "id")


def test_feature_cache_commits(spark, vectors, tmp_path):
    at = f"file://{tmp_path}/c"
    w = C.FeatureCacheWriter(spark, at, C.Settings(35, 32, "amo_fast", 1, 2))
    first, rest = vectors.where("id < 10"), vectors.where("id >= 10")
    w.write(first, "x", "id")
    keep, w.publish = w.publish, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        w.append(rest, "x", "id")
    assert len(C.FeatureCacheDataset(spark, at)) == C.FeatureCacheDataset(spark, at).codes().count() == 10
    w.publish = keep
    w.append(rest, "x", "id")
    c = C.FeatureCacheDataset(spark, at)
    assert sorted(r.sample_id for r in c.codes().collect()) == list(range(23)) and c.tokens().count() == 46 and c.sample(5, 1).count() == 5
    whole = {r.id: r.decoded for r in Q.decompress(Q.encode(vectors, "x", "amo_fast")).collect()}
    assert {r.sample_id: r.decoded for r in c.decoded().collect()} == whole
    assert [r.sample_id for r in c.sample(5, 1).collect()] != [r.sample_id for r in c.sample(5, 2).collect()]
    for bad in (vectors.selectExpr("greatest(id, 1) - 1 as id", "x"), vectors.selectExpr("id + 1 as id", "x"), vectors.selectExpr("nullif(id, 4) as id", "x")):
        with pytest.raises(ValueError):
            w.write(bad, "x", "id")
    w.write(first, "x", "id")
    assert len(C.FeatureCacheDataset(spark, at)) == 10 and len(list((tmp_path / "c" / "data").iterdir())) == 1


@pytest.mark.parametrize("mode", Q.MODES)
def test_stored_form(spark, vectors, tmp_path, mode):
    at = f"file://{tmp_path}/c"
    C.FeatureCacheWriter(spark, at, C.Settings(70, 32, mode, 2)).write(vectors, "x", "id")
    c = C.FeatureCacheDataset(spark, at)
    assert {r.sample_id: r.decoded for r in c.decoded().collect()} == {r.id: r.decoded for r in Q.decompress(Q.encode(vectors, "x", mode)).collect()}
    assert c.info()["stored_bytes_per_value"] == pytest.approx(Q.bytes_per_value(mode, 32), rel=0.08)


def test_pixel_caches(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = [np.clip(rng.normal(120, 20, (24, 40, 3)), 0, 255).astype(np.uint8) for _ in range(5)]
    df = spark.createDataFrame([(i, 24, 40, 3, bytearray(x.tobytes())) for i, x in enumerate(images)], "id long, height int, width int, channels int, data binary")
    for quant, most in (("raw", 0), ("int4", 12), ("int3", 25), ("xs", 30)):
        at = f"file://{tmp_path}/{quant}"
        P.PixelCacheWriter(spark, at, quant, "ultra" if quant == "xs" else "balanced").write(df)
        c = P.PixelCacheDataset(spark, at)
        for r in c.images().collect():
            back = np.frombuffer(bytes(r.data), np.uint8).reshape(24, 40, 3)
            assert np.sqrt(((images[r.id].astype(float) - back) ** 2).mean()) <= most
        assert c.loader(2, drop_last=True).count() == 4


def test_pixel_cache_grows(spark, tmp_path):
    rng = np.random.default_rng(2)
    images = np.clip(rng.normal(120, 30, (5, 32, 32, 3)), 0, 255).astype(np.uint8)
    for entropy in ("rans", "tans"):
        at = f"file://{tmp_path}/{entropy}"
        w = P.PixelCacheWriter(spark, at, "xs", "high", entropy, half_chroma=True, block=128, codebook=[0.25 * k for k in range(1, 17)])
        w.append_batch([0, 1, 2], images[:3])
        w.append_image(3, images[3])
        c = P.PixelCacheDataset(spark, at)
        assert len(c) == 4 and c.info()["half_chroma"] and sorted(r.id for r in c.images().collect()) == [0, 1, 2, 3]
        whole = {r.id: bytes(r.data) for r in c.images().collect()}
        assert bytes(c.get(-1).first().data) == whole[3] and bytes(c.unpack_arena(c.get_arena(2)).first().data) == whole[2]
        assert c.get_arena_packed(1).first().code.meta == c.get_arena(1).first().meta
        got = {r.id: bytes(r.data) for r in c.unpack_arena(c.loader(3, True, 1, kind="arenas")).collect()}
        assert got == whole and c.loader(3, kind="packed").count() == 4
        rows = P.collate(c.loader(3)).orderBy("batch_id").collect()
        assert [r.ids for r in rows] == [[0, 1, 2], [3]] and bytes(rows[0].data[1]) == whole[1]
        for bad in (lambda: w.append_image(3, images[4]), lambda: w.append_image(9, images[4][:16]), lambda: P.PixelCacheWriter(spark, at, "xs", "ultra").append_image(8, images[4]), lambda: c.get(7).count()):
            with pytest.raises((ValueError, IndexError)):
                bad()
        assert len(P.PixelCacheDataset(spark, at)) == 4
    with pytest.raises(ValueError):
        P.PixelCacheWriter(spark, at, entropy="tans", dictionary={"u8": [], "i8": [], "ll4": []})


def test_metrics(spark):
    df = spark.createDataFrame([(float(i), float(i) + 0.5) for i in range(1000)], "x double, r double")
    m = M.tensor_metrics(df).first()
    assert m.max_err == 0.5 and m.n == 1000
    assert M.outlier_error(df, 0.01).first().k == 10
    assert M.estimate(100, 32)["total_bytes"] == 112


def test_stream(spark, sf, tmp_path):
    from tesserae.streaming import encode_stream

    src = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    src.repartition(3).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = encode_stream(s, "embedding", f"{tmp_path}/out", f"{tmp_path}/cp", "sym")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == src.count() and got.select("batch").distinct().count() == 3


def test_command_line(capsys):
    from tesserae.__main__ import main

    assert main(["info"]) == 0 and "balanced" in capsys.readouterr().out
    assert main(["help"]) == 0 and "cache-info" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["--version"])
    assert "tesserae" in capsys.readouterr().out


def test_image_directory(spark, tmp_path):
    import struct
    import zlib

    def png(a):
        h, w, _ = a.shape
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"".join(b"\0" + r.tobytes() for r in a)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    a = np.random.default_rng(3).integers(0, 256, (16, 16, 3), dtype=np.uint8)
    (tmp_path / "d").mkdir()
    for k in range(3):
        (tmp_path / "d" / f"{k}.png").write_bytes(png(np.roll(a, k, 0)))
    from tesserae.sources.images import read_directory

    rows = read_directory(spark, f"file://{tmp_path}/d", 16, 16).orderBy("id").collect()
    assert [r.id for r in rows] == [0, 1, 2] and bytes(rows[0].data) == a.tobytes()
    (tmp_path / "d" / "9.png").write_bytes(b"not an image")
    from tesserae.sources.images import invalid_files

    assert invalid_files(spark, f"file://{tmp_path}/d").count() == 1
    with pytest.raises(Exception, match="can't be decoded"):
        read_directory(spark, f"file://{tmp_path}/d", 16, 16).collect()
    assert read_directory(spark, f"file://{tmp_path}/d", 16, 16, skip_invalid=True).count() == 3
    (tmp_path / "d" / "9.png").unlink()
    out = P.cache_images(spark, f"file://{tmp_path}/d", f"file://{tmp_path}/cache", 16, 16, quant="raw")
    assert out["num_samples"] == 3 and F is not None
