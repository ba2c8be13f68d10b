"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The network reads windows of SLICE bytes, words and spaces alike, with MARGIN bytes of the same text
on either side to settle its state, and gives every byte position a distribution over the languages.
A document's distribution is the mean over all its positions, whatever its length. Each direction is
a light gated unit (an update gate and a candidate, both softsigns, no reset gate): on the bytes of
a corpus the elementwise work is what costs. It is trained here, by backpropagation through time
with Adam, on windows of a bounded sample of labelled rows, and on noise: letters and bytes drawn at
random are a class of their own. Noise is never a prediction; `select_known` rejects what is mostly that.

Defined results: null texts and texts without a letter get `und` with score 0, and so does every
text where there are no labelled rows to learn from; rows with a null language are not learned from
but predicted; repeated rows get equal results; of equally probable languages the first by name is
named; language, source and id are no inputs; very long texts are read in windows like others; an
empty table gives an empty one; other columns, of whatever name, never clash with those added, which
`predict` calls `li_pred`, `li_score` and `li_noise`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN, EMBED, BATCH, STEPS, RATE, SEED = 8, 8, 256, 160, 0.04, 3
#: The sample that training may read: documents of a language, pieces of each and characters of a piece, and languages.
SAMPLE_DOCS, PIECES, PIECE_CHARS, SPARE, MAX_LANGS = 300, 6, 200, 4, 128
SLICE, MARGIN, TRAIN_BYTES = 480, 16, 64
#: Windows computed together, and bytes of text gathered before that.
WINDOWS, GATHER = 1024, 1 << 19
HELD_OUT, MOST_NOISE = 2, 0.5


def softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Unit:
    """One direction: W (256 x 2h, input by byte), U (h x 2h); the gate first, then the candidate."""

    @staticmethod
    def states(w: np.ndarray, u: np.ndarray, ids: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
        """ids (time, batch) -> states (time, batch, hidden); where alive is 0 the state stays as it was."""
        k = len(u)
        wz, wn, uz, un = (np.ascontiguousarray(x) for x in (w[:, :k], w[:, k:], u[:, :k], u[:, k:]))
        h = np.zeros((ids.shape[1], k), np.float32)
        out = np.empty((*ids.shape, k), np.float32)
        z, n, gz, gn, size = (np.empty_like(h) for _ in range(5))
        whole = None if alive is None else alive.all((1, 2))
        for t in range(len(ids)):
            np.take(wz, ids[t], axis=0, out=gz, mode="clip")
            np.take(wn, ids[t], axis=0, out=gn, mode="clip")
            np.matmul(h, uz, out=z)
            np.matmul(h, un, out=n)
            for a, g in ((z, gz), (n, gn)):
                a += g
                np.abs(a, out=size)
                size += 1
                a /= size
            z += 1
            n -= h
            n *= z
            n *= 0.5
            if alive is not None and not whole[t]:
                n *= alive[t]
            h += n
            out[t] = h
        return out

    @staticmethod
    def backward(w: np.ndarray, u: np.ndarray, ids: np.ndarray, alive: np.ndarray, out: np.ndarray, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of W and U from those of the states."""
        k = len(u)
        gu, dh, das = np.zeros_like(u), np.zeros_like(out[0]), np.empty((*ids.shape, 2 * k), np.float32)
        for t in range(len(ids) - 1, -1, -1):
            h = out[t - 1] if t else np.zeros_like(out[0])
            a = w[ids[t]] + h @ u
            size = 1 + np.abs(a)
            s, slope = a / size, 1 / (size * size)
            z, n, m = 0.5 + 0.5 * s[:, :k], s[:, k:], alive[t]
            dh = dh + dout[t]
            da = np.concatenate([dh * m * (n - h) * 0.5, dh * m * z], 1) * slope
            das[t] = da
            gu += h.T @ da
            dh = dh * (1 - m * z) + da @ u.T
        gw = np.stack([np.bincount(ids.ravel(), das[:, :, j].ravel(), 256) for j in range(2 * k)], 1)
        return gw.astype(np.float32), gu


def padded(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, batch) bytes and (time, batch, 1) mask."""
    longest = max(map(len, segments))
    ids = np.frombuffer(b"".join(s.ljust(longest, b"\0") for s in segments), np.uint8).reshape(len(segments), longest).T
    mask = (np.arange(longest)[:, None] < np.array([len(s) for s in segments])[None]).astype(np.float32)
    return ids.astype(np.intp), mask[:, :, None]


class Model:
    """Byte embedding, a gated unit in each direction, and a linear layer on every position; the last class is noise."""

    def __init__(self, langs: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.langs = langs
        self.p = {"E": (rng.normal(size=(256, EMBED)) * 0.5).astype(np.float32), "V": n(2 * HIDDEN, len(langs) + 1), "c": np.zeros(len(langs) + 1, np.float32)}
        for d in "fb":
            self.p |= {d + "W": n(EMBED, 2 * HIDDEN), d + "U": n(HIDDEN, 2 * HIDDEN), d + "b": np.zeros(2 * HIDDEN, np.float32)}

    def inputs(self, d: str) -> np.ndarray:
        """What each byte gives to the gate and the candidate."""
        return self.p["E"] @ self.p[d + "W"] + self.p[d + "b"]

    def positions(self, ids: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
        """(classes, time, batch) probabilities of windows ids (time, batch)."""
        p, (t, b) = self.p, ids.shape
        v, back = p["V"].T, None if alive is None else alive[::-1]
        # what stands after a window's end never comes before a counted position, so only the backward unit waits
        e = (v[:, :HIDDEN] @ Unit.states(self.inputs("f"), p["fU"], ids).reshape(t * b, -1).T).reshape(-1, t, b)
        e += (v[:, HIDDEN:] @ Unit.states(self.inputs("b"), p["bU"], ids[::-1], back).reshape(t * b, -1).T).reshape(-1, t, b)[:, ::-1]
        e += p["c"][:, None, None]
        if np.abs(v).sum(1).max() + np.abs(p["c"]).max() > 80:  # states lie within -1 and 1
            e -= e.max(0)
        np.exp(e, out=e)
        e /= e.sum(0)
        return e

    def sums(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(texts, classes) sums of the probabilities over all bytes of each text; text k is data[ends[k-1]:ends[k]]."""
        begins = np.concatenate([[0], ends[:-1]])
        n = -(-(ends - begins) // SLICE)
        text = np.repeat(np.arange(len(ends)), n)
        first = begins[text] + SLICE * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        last = np.minimum(first + SLICE, ends[text])
        left, right = np.maximum(first - MARGIN, begins[text]), np.minimum(last + MARGIN, ends[text])
        out = np.zeros((len(ends), len(self.p["c"])))
        order = np.argsort(left - right, kind="stable")  # windows of like length together
        for k in range(0, len(order), WINDOWS):
            own = order[k:k + WINDOWS]
            size = right[own] - left[own]
            t = np.arange(size.max())[:, None]
            ids = data[np.minimum(left[own] + t, len(data) - 1)].astype(np.intp)
            alive = None if size.min() == size.max() else (t < size).astype(np.float32)[:, :, None]
            counted = (t >= first[own] - left[own]) & (t < last[own] - left[own])
            np.add.at(out, text[own], np.einsum("ltb,tb->bl", self.positions(ids, alive), counted.astype(np.float32)))
        return out

    def step(self, segments: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross entropy over positions."""
        p = self.p
        ids, mask = padded(segments)
        w = {d: self.inputs(d) for d in "fb"}
        f = Unit.states(w["f"], p["fU"], ids, mask)
        b = Unit.states(w["b"], p["bU"], ids[::-1], mask[::-1])
        h = np.concatenate([f, b[::-1]], 2)
        e = h @ p["V"] + p["c"]
        e = np.exp(e - e.max(2, keepdims=True))
        e /= e.sum(2, keepdims=True)
        e[:, np.arange(len(y)), y] -= 1
        e *= mask / mask.sum()
        g = {"V": np.tensordot(h, e, ((0, 1), (0, 1))), "c": e.sum((0, 1)), "E": np.zeros_like(p["E"])}
        dh = e @ p["V"].T
        for d, gw, gu in (("f", *Unit.backward(w["f"], p["fU"], ids, mask, f, dh[:, :, :HIDDEN])), ("b", *Unit.backward(w["b"], p["bU"], ids[::-1], mask[::-1], b, dh[::-1, :, HIDDEN:]))):
            g |= {d + "W": p["E"].T @ gw, d + "b": gw.sum(0), d + "U": gu}
            g["E"] += gw @ p[d + "W"].T
        return g


def noise(rng: np.random.Generator) -> bytes:
    """Words of random letters, of letters and digits, or of random bytes."""
    letters = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", bytes(range(128, 256)))[int(rng.integers(3))]
    draw = rng.choice(np.frombuffer(letters, np.uint8), TRAIN_BYTES)
    draw[rng.random(TRAIN_BYTES) < 0.12 * rng.random()] = 32
    return draw.tobytes()


def fit(rows: list[tuple[str, str]], steps: int | None = None, seed: int = SEED) -> Model | None:
    """Train on (text, language) rows, by windows of TRAIN_BYTES that start anywhere in a text."""
    langs, steps = sorted({lang for _, lang in rows}), steps or STEPS
    if not langs:
        return None
    model, rng = Model(langs, seed), np.random.default_rng(seed + 1)
    texts = {lang: [t for t in ((text or "").encode("utf-8", "replace") for text, own in rows if own == lang) if t.strip()] for lang in langs}
    chance = {lang: np.cumsum([len(t) for t in own]) for lang, own in texts.items()}
    classes = [k for k, lang in enumerate(langs) if texts[lang]]
    if not classes:
        return model
    classes.append(len(langs))

    def window(k: int) -> bytes:
        if k == len(langs):
            return noise(rng)
        lang = langs[k]
        at = int(rng.integers(chance[lang][-1]))
        text = texts[lang][int(np.searchsorted(chance[lang], at, side="right"))]
        a = int(rng.integers(max(1, len(text) - TRAIN_BYTES + 1)))
        return text[a:a + int(rng.integers(TRAIN_BYTES // 8, TRAIN_BYTES + 1))]

    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for t in range(1, steps + 1):
        y = rng.choice(classes, BATCH)
        g = model.step([window(k) for k in y], y)
        rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, x in g.items():
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return model


def has_letter(text: str) -> bool:
    """A character of Unicode category L. (The first letter is found at once in most texts.)"""
    return any(unicodedata.category(ch)[0] == "L" for ch in text)


def judged(text: pa.Array, model: Model | None) -> tuple[list[str], list[float], list[float]]:
    """Language, score among the languages, and share of noise of each text; about GATHER bytes are computed at a time."""
    pred, score, share = ["und"] * len(text), [0.0] * len(text), [0.0] * len(text)
    held, size = [], 0

    def flush() -> None:
        if held and model:
            ends = np.cumsum([len(b) for _, b in held])
            for (i, _), s in zip(held, model.sums(np.frombuffer(b"".join(b for _, b in held), np.uint8), ends), strict=True):
                own = s[:-1]
                k = int(own.argmax())
                pred[i], score[i], share[i] = model.langs[k], float(min(1.0, own[k] / max(own.sum(), 1e-300))), float(min(1.0, s[-1] / s.sum()))
        held.clear()

    for i, t in enumerate(text):
        t = t.as_py()
        if t is not None and has_letter(t):
            held.append((i, t.encode("utf-8", "replace")))
            size += len(held[-1][1])
            if size >= GATHER:
                flush()
                size = 0
    flush()
    return pred, score, share


def fields(docs: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in columns)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with li_pred, li_score and li_noise; the text column is read and dropped."""
    keep = [c for c in docs.columns if c not in ("text", "li_pred", "li_score", "li_noise")]
    schema = fields(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, share = judged(b.column(len(keep)), model)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], names=[*keep, "li_pred", "li_score", "li_noise"])

    return docs.select(*[quoted(c) for c in keep], "text").mapInArrow(run, schema + (", " if keep else "") + "li_pred string, li_score double, li_noise double")


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def select_known(docs: DataFrame, model: Model | None, most_noise: float = MOST_NOISE) -> DataFrame:
    """The rows of docs that have a letter and of which the model takes at most the share most_noise for noise.

    Without a model to judge by, all rows that have a letter stay. Rows pass through the workers
    once and come back as they were.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(at)
            if model:
                pred, _, share = judged(text, model)
                ok = [p != "und" and x <= most_noise for p, x in zip(pred, share, strict=True)]
            else:
                ok = [t.is_valid and has_letter(t.as_py()) for t in text]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4


def sampled(text: Column, k: Column) -> Column:
    """A text of at most PIECES * PIECE_CHARS characters whole; of a longer one PIECES pieces, as its hash k places them."""
    n = F.length(text)
    places = F.transform(F.array(*[F.lit(j) for j in range(PIECES)]), lambda j: F.pmod(F.xxhash64(k, j), (n - PIECE_CHARS + 1).cast("long")).cast("int"))
    return F.when(n <= PIECES * PIECE_CHARS, F.array(text)).otherwise(F.transform(places, lambda a: F.substr(text, a + 1, F.lit(PIECE_CHARS))))


def train(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, max_langs: int = MAX_LANGS) -> Model | None:
    """Fit on at most docs_per_lang distinct texts a language that are not held out: those of smallest hash.

    An estimate of each language's distinct texts gives a hash bound that leaves about SPARE times as
    many as are needed, copies are merged before they move, and only those few are ranked. Of a long
    text some pieces are learned from, which may lie anywhere in it. The max_langs languages with
    most texts are learned (the first by name of equals); the bound keeps the network's output, and
    what the driver collects, from growing with a dirty column.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != HELD_OUT))
    rows = labelled.select("text", "lang", F.xxhash64("text").alias("k"))
    texts = rows.groupBy("lang").agg(F.approx_count_distinct("k").alias("texts"))
    found = [(r.lang, int(r.texts)) for r in texts.orderBy(F.desc("texts"), "lang").limit(max_langs).collect()]
    if not found:
        return None
    bounds = docs.sparkSession.createDataFrame([(lang, min(float(1 << 40), float(1 << 40) * SPARE * docs_per_lang / max(n, 1))) for lang, n in found], "lang string, bound double")
    near = F.pmod(F.col("k"), F.lit(1 << 40)) < F.col("bound")
    rows = rows.join(F.broadcast(bounds), "lang").where(near).select("lang", "k", sampled(F.col("text"), F.col("k")).alias("pieces"))  # max_langs rows
    rows = rows.groupBy("lang", "k").agg(F.min("pieces").alias("pieces"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("k"))
    picked = rows.withColumn("r", first).where(F.col("r") <= docs_per_lang).select("pieces", "lang").collect()
    return fit(sorted((t, r.lang) for r in picked for t in r.pieces))


def report(docs: DataFrame) -> DataFrame:
    """The columns of op9."""
    model = train(docs)
    held = F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", F.col("li_pred").alias("lang_pred"), F.col("li_score").alias("score"))
