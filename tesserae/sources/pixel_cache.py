"""Pixel caches: one Parquet row per image, raw or coded, with one-row metadata tables.

Like feature caches, each write or append is a commit that counts once the metadata names it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import entropy as E
from tesserae.functions import wavelet as W
from tesserae.operators import images as I
from tesserae.sources.feature_cache import numbered
from tesserae.sources.tables import newest, publish, sweep

META = (
    "num_samples long, height int, width int, channels int, quant string, group_size int, mode string, entropy string, dictionary string,"
    " half_chroma boolean, codebook array<double>, block int, commits array<string>"
)
ARENA = "id long, u8 binary, i8 binary, ll4 binary, meta array<array<int>>"
#: Images that a dictionary is learned from: a bounded sample, those of smallest hash of their id.
CALIBRATION = 256


def stacked(rows: Iterator) -> Iterator[np.ndarray]:
    """Images (n, h, w, c) of rows in their order: those of one size together, up to about a megabyte."""
    shape = lambda r: (r.height, r.width, r.channels)
    held: list = []
    for r in rows:
        if held and (shape(r) != shape(held[0]) or (len(held) + 1) * len(r.data) > 1 << 20):
            yield np.frombuffer(b"".join(bytes(x.data) for x in held), np.uint8).reshape(len(held), *shape(held[0]))
            held = []
        held.append(r)
    if held:
        yield np.frombuffer(b"".join(bytes(x.data) for x in held), np.uint8).reshape(len(held), *shape(held[0]))


def learn(images: DataFrame, mode: str, k: int = 8, block: int = 256, half_chroma: bool | None = None, codebook: np.ndarray = W.CODEBOOK, calibration: int = CALIBRATION) -> dict[str, list[list[int]]]:
    """Dictionaries of the three section kinds from a sample of images."""
    rows = images.orderBy(F.xxhash64("id"), "id").limit(calibration).select("height", "width", "channels", "data")
    parts: dict[str, list[np.ndarray]] = {kind: [] for kind in I.KINDS}
    q_scale, lamb = W.PRESETS[mode]
    half = (mode not in W.FULL_CHROMA) if half_chroma is None else half_chroma
    for own in stacked(rows.toLocalIterator()):
        for arena in W.arena_pack_all(*W.adaptive_encode(own, None, q_scale, lamb, half, codebook)):
            for kind, raw in (("u8", arena["u8"]), ("i8", arena["i8"]), ("ll4", arena["ll4"][0::2]), ("ll4", arena["ll4"][1::2])):
                parts[kind].append(E.block_histograms(raw, block))
    return {kind: [t.tolist() for t in E.learn_dictionary(np.concatenate(h), k)] for kind, h in parts.items()}


def checked(tables: dict | None) -> dict | None:
    """A supplied dictionary: tables of 256 frequencies that sum to 4096 for each section kind."""
    if tables is None:
        return None
    if set(tables) != set(I.KINDS):
        raise ValueError(f"a dictionary needs tables of {', '.join(I.KINDS)}")
    for kind, own in tables.items():
        if not 1 <= len(own) <= 256 or any(len(t) != 256 or min(t) < 0 or sum(t) != 4096 for t in own):
            raise ValueError(f"{kind} needs 1 to 256 tables of 256 frequencies that sum to 4096")
    return {kind: [[int(x) for x in t] for t in own] for kind, own in tables.items()}


class PixelCacheWriter:
    """Options for wavelet caches: halved chroma (by default as the mode has it), the codebook of 16 step multipliers, and, for table coding, block length, dictionary and size of its calibration sample."""

    def __init__(
        self, spark: SparkSession, path: str, quant: str = "xs", mode: str = "balanced", entropy: str = "rans", group_size: int = 32, dictionary: dict | None = None,
        half_chroma: bool | None = None, codebook: list[float] | None = None, block: int = 256, calibration: int = CALIBRATION,
    ) -> None:
        if quant not in I.QUANTS or entropy not in I.ENTROPY or mode not in W.PRESETS or min(group_size, block, calibration) <= 0:
            raise ValueError("unknown quant, mode or entropy, or a group size, block or calibration below 1")
        if codebook is not None and (len(codebook) != 16 or min(codebook) <= 0):
            raise ValueError("a codebook has 16 positive multipliers")
        self.spark, self.path, self.quant, self.mode, self.entropy, self.group, self.dictionary = spark, path.rstrip("/"), quant, mode, entropy, group_size, checked(dictionary)
        self.half = (mode not in W.FULL_CHROMA) if half_chroma is None else half_chroma
        self.codebook, self.block, self.calibration = [float(x) for x in (W.CODEBOOK if codebook is None else codebook)], block, calibration

    def write(self, images: DataFrame) -> None:
        """images (id, height, width, channels, data), all of one size; replaces the cache."""
        size = self.size_of(images)
        if self.quant == "xs" and self.entropy == "tans" and self.dictionary is None:
            self.dictionary = learn(images, self.mode, block=self.block, half_chroma=self.half, codebook=np.array(self.codebook), calibration=self.calibration)
        commit = self.store(images)
        self.publish(size, [commit])
        sweep(self.spark, self.path, [commit])

    def append(self, images: DataFrame) -> None:
        """Add images with ids that the cache doesn't have; the stored settings, dictionary included, hold."""
        c = PixelCacheDataset(self.spark, self.path)
        m = c.meta
        if (m["quant"], m["group_size"], m["mode"], m["entropy"], m["half_chroma"], m["codebook"], m["block"]) != (self.quant, self.group, self.mode, self.entropy, self.half, self.codebook, self.block):
            raise ValueError("the cache has other settings")
        size = self.size_of(images)
        if size != (m["height"], m["width"], m["channels"]):
            raise ValueError(f"images of the cache are {m['height']} x {m['width']} x {m['channels']}")
        if images.join(c.rows().select("id"), "id", "left_semi").limit(1).count():
            raise ValueError("the cache has some of these ids")
        self.dictionary = c.tables
        self.publish(size, [*m["commits"], self.store(images)])

    def append_batch(self, ids: list[int], images: np.ndarray) -> None:
        """append() of an array (n, height, width, channels) of the driver."""
        a = np.asarray(images, np.uint8)
        a = a[..., None] if a.ndim == 3 else a
        rows = [(int(i), *a.shape[1:], bytearray(x.tobytes())) for i, x in zip(ids, a, strict=True)]
        df = self.spark.createDataFrame(rows, "id long, height int, width int, channels int, data binary")
        (self.append if self.there() else self.write)(df)

    def append_image(self, i: int, image: np.ndarray) -> None:
        """append() of one image, (height, width) or (height, width, channels); makes the cache if there is none."""
        a = np.asarray(image, np.uint8)
        self.append_batch([i], (a[..., None] if a.ndim == 2 else a)[None])

    def there(self) -> bool:
        try:
            return bool(newest(self.spark, self.path, META))
        except FileNotFoundError:
            return False

    def size_of(self, images: DataFrame) -> tuple[int, int, int]:
        size = images.select("height", "width", "channels").distinct().limit(2).collect()
        if len(size) != 1:
            raise ValueError("images must have one size")
        if size[0].channels not in (1, 3) or (self.quant == "xs" and size[0].channels != 3):
            raise ValueError("images need 1 or 3 channels, wavelet caches 3")
        if images.select(F.count("id") != F.count(F.lit(1))).first()[0] or images.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("ids must not repeat or be null")
        return tuple(size[0])

    def store(self, images: DataFrame) -> str:
        quant, mode, entropy, group, tables, half, book, block = self.quant, self.mode, self.entropy, self.group, self.dictionary, self.half, np.array(self.codebook), self.block

        def code(stack: np.ndarray) -> list[dict]:
            if quant == "xs":
                return [{"code": x} for x in I.xs_encode(stack, mode, entropy, tables, half, book, block)]
            if quant == "raw":
                return [{"q": x.tobytes(), "scales": []} for x in stack]
            q, s = I.blockwise(stack, int(quant[-1]), group)
            return [{"q": a.tobytes(), "scales": b.tolist()} for a, b in zip(q, s, strict=True)]

        schema = f"code {I.XS}" if quant == "xs" else "q binary, scales array<double>"
        commit = uuid.uuid4().hex
        I.map_images(images.select("id", "height", "width", "channels", "data"), code, schema).drop("data").write.parquet(f"{self.path}/data/commit={commit}")
        return commit

    def publish(self, size: tuple[int, int, int], commits: list[str]) -> None:
        n = self.spark.read.parquet(*[f"{self.path}/data/commit={c}" for c in commits]).count()
        tables = json.dumps(self.dictionary) if self.dictionary else None
        publish(self.spark, self.path, (n, *size, self.quant, self.group, self.mode, self.entropy, tables, self.half, self.codebook, self.block, commits), META)


class PixelCacheDataset:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.meta = newest(spark, self.path, META)
        self.tables = json.loads(self.meta["dictionary"]) if self.meta["dictionary"] else None

    def __len__(self) -> int:
        return self.meta["num_samples"]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/commit={c}" for c in self.meta["commits"]])

    def decode(self, rows: DataFrame, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
        """Stored rows, and whatever else they carry, with data decoded to uint8 bytes; transform maps an (h, w, c) image to another array."""
        m, tables = self.meta, self.tables
        h, w, c, quant, group, half, book = m["height"], m["width"], m["channels"], m["quant"], m["group_size"], m["half_chroma"], np.array(m["codebook"])
        code = ["code"] if quant == "xs" else ["q", "scales"]
        kept = ["id", *(x for x in rows.columns if x not in ("id", "height", "width", "channels", "data", *code))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, I.BATCH):
                    b = whole.slice(at, I.BATCH)
                    if quant == "xs":
                        got = I.xs_decode(b.column("code").to_pylist(), half, h, w, tables, book)
                    else:
                        q = np.frombuffer(b"".join(b.column("q").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                        flat = q if quant == "raw" else I.unblockwise(q.view(np.int8), np.array(b.column("scales").to_pylist()), group)
                        got = list(flat.reshape(-1, h, w, c))
                    yield pa.record_batch({**{x: b.column(x) for x in kept}, "data": pa.array([(transform(x) if transform else x).tobytes() for x in got], pa.binary())})

        kinds = ", ".join(f"`{x}` {rows.schema[x].dataType.simpleString()}" for x in kept)
        return rows.select(*kept, *code).mapInArrow(run, f"{kinds}, data binary")

    def images(self, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
        """(id, data) of all images."""
        return self.decode(self.rows(), transform)

    def row(self, i: int) -> DataFrame:
        """The stored row of an id; negative numbers count from the end of ids 0..n-1."""
        i = i + len(self) if i < 0 else i
        df = self.rows().where(F.col("id") == i)
        if not 0 <= i < len(self) and not df.limit(1).count():
            raise IndexError(i)
        return df

    def get(self, i: int) -> DataFrame:
        return self.decode(self.row(i))

    def arenas(self, rows: DataFrame | None = None) -> DataFrame:
        """ARENA rows: both byte streams, coarse planes and table of offsets, with sections decoded and pixels not."""
        if self.meta["quant"] != "xs":
            raise ValueError("only wavelet caches have arenas")
        tables = self.tables

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, I.BATCH):
                    b = whole.slice(at, I.BATCH)
                    got = I.xs_arenas(b.column("code").to_pylist(), tables)
                    yield pa.record_batch({"id": b.column("id"), **{k: pa.array([a[k] for a in got], pa.binary()) for k in ("u8", "i8", "ll4")}, "meta": pa.array([a["meta"] for a in got], pa.list_(pa.list_(pa.int32())))})

        return (self.rows() if rows is None else rows).select("id", "code").mapInArrow(run, ARENA)

    def get_arena(self, i: int) -> DataFrame:
        return self.arenas(self.row(i))

    def get_arena_packed(self, i: int) -> DataFrame:
        """(id, code): sections as they are stored."""
        if self.meta["quant"] != "xs":
            raise ValueError("only wavelet caches have arenas")
        return self.row(i).select("id", "code")

    def unpack_arena(self, arenas: DataFrame) -> DataFrame:
        """(id, data) from ARENA rows."""
        m = self.meta
        h, w, half, book = m["height"], m["width"], m["half_chroma"], np.array(m["codebook"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, I.BATCH):
                    rows = b.slice(at, I.BATCH).to_pylist()
                    yield pa.record_batch({"id": pa.array([r["id"] for r in rows], pa.int64()), "data": pa.array([W.adaptive_decode(W.arena_unpack(r, half, h, w), half, h, w, book)[0].tobytes() for r in rows], pa.binary())})

        return arenas.select("id", "u8", "i8", "ll4", "meta").mapInArrow(run, "id long, data binary")

    def loader(self, batch_size: int = 32, shuffle: bool = False, seed: int = 0, drop_last: bool = False, kind: str = "pixels") -> DataFrame:
        """Rows with batch_id, shuffled by a seeded hash of the id: decoded `pixels`, `arenas`, or sections as they are (`packed`).

        Stored rows move to their batches; what is asked for is decoded after that.
        """
        key = F.xxhash64("id", F.lit(seed)) if shuffle else F.col("id")
        df = numbered(self.rows().select("id").withColumn("__k", key), "__k", "__n").select("id", F.floor(F.col("__n") / batch_size).alias("batch_id"))
        df = df.where(F.col("batch_id") < len(self) // batch_size) if drop_last else df
        rows = self.rows().join(df, "id")
        if kind == "pixels":
            return self.decode(rows)
        if kind not in ("arenas", "packed") or self.meta["quant"] != "xs":
            raise ValueError("kind is pixels or, for wavelet caches, arenas or packed")
        packed = rows.select("id", "batch_id", "code")
        return packed if kind == "packed" else self.arenas(packed).join(df, "id")

    def sizes(self) -> DataFrame:
        """(id, bytes) stored for each image."""
        if self.meta["quant"] != "xs":
            return self.rows().select("id", (F.octet_length("q") + 2 * F.size("scales")).cast("long").alias("bytes"))
        return self.rows().select("id", (F.octet_length("code.u8.blob") + F.octet_length("code.i8.blob") + F.octet_length("code.ll4.blob") + F.size("code.meta") * 32).cast("long").alias("bytes"))

    def info(self) -> dict:
        m, size = self.meta, self.sizes().agg(F.sum("bytes")).first()[0] or 0
        raw = len(self) * m["height"] * m["width"] * m["channels"]
        return {k: v for k, v in m.items() if k not in ("dictionary", "commits")} | {"bytes": size, "raw_bytes": raw, "ratio_vs_raw": raw / size if size else None}


def collate(rows: DataFrame, column: str = "data") -> DataFrame:
    """(batch_id, ids, column as an array): one row for each batch of a loader, in the order of ids; its size is the batch size."""
    pairs = F.array_sort(F.collect_list(F.struct("id", F.col(column).alias("v"))))
    return rows.groupBy("batch_id").agg(pairs.alias("p")).select("batch_id", F.transform("p", lambda x: x["id"]).alias("ids"), F.transform("p", lambda x: x["v"]).alias(column))


def cache_images(spark: SparkSession, directory: str, path: str, height: int, width: int, limit: int | None = None, **kw) -> dict:
    """A directory of image files to a cache; number, bytes and ratio."""
    from tesserae.sources.images import read_directory

    PixelCacheWriter(spark, path, **kw).write(read_directory(spark, directory, height, width, 3, limit))
    i = PixelCacheDataset(spark, path).info()
    return {k: i[k] for k in ("num_samples", "bytes", "raw_bytes", "ratio_vs_raw")}
