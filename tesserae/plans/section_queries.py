"""Entropy queries over the UTF-8 bytes of `documents` and the codes of `embeddings`, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import entropy as E
from tesserae.operators import sections as S
from tesserae.plans.quant_queries import d, sql_sym, sql_values, sym
from tesserae.sources.tables import scan

QUERIES: dict = {}
SQL: dict[str, str] = {}
BLOCK = 2048
#: Toy dictionary: table k has one peak, all other symbols frequency 1 of 4096.
PEAKS = (32, 101)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark, path):
    return scan(spark, path, "documents", "doc_id", "text")


def text():
    return F.encode(F.coalesce("text", F.lit("")), "UTF-8")


def toy() -> list[list[int]]:
    return [[4096 - 255 if s == p else 1 for s in range(256)] for p in PEAKS]


BYTES = "h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), y AS (SELECT doc_id, i - 1 AS pos, CAST('0x' || substr(x, CAST(2 * i - 1 AS BIGINT), 2) AS INTEGER) AS byte FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 + 1)) AS i FROM h))"


@query(f"WITH {BYTES} SELECT byte, CAST(count(*) AS BIGINT) AS n FROM y GROUP BY byte")
def byte_histogram(spark, path):
    return S.byte_histogram(docs(spark, path), text())


@query(f"WITH {BYTES} SELECT doc_id, CAST(pos // {BLOCK} AS BIGINT) AS block, CAST(byte AS BIGINT) AS byte, CAST(count(*) AS BIGINT) AS n FROM y GROUP BY ALL")
def block_histogram(spark, path):
    return S.block_histograms(docs(spark, path), "doc_id", text(), BLOCK)


@query(f"WITH {BYTES}, c AS (SELECT doc_id, byte, count(*) AS n FROM y GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY doc_id) SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) + {d(0.0)} AS shannon FROM c JOIN t USING (doc_id) GROUP BY doc_id UNION ALL SELECT doc_id, {d(0.0)} FROM documents WHERE coalesce(text, '') = ''")
def shannon_entropy(spark, path):
    return S.entropies(docs(spark, path), "doc_id", text(), BLOCK).select("doc_id", (F.round("shannon", 6) + 0.0).alias("shannon"))


@query(f"WITH {BYTES}, c AS (SELECT doc_id, pos // {BLOCK} AS b, byte, count(*) AS n FROM y GROUP BY ALL), t AS (SELECT doc_id, b, sum(n) AS t FROM c GROUP BY ALL), e AS (SELECT doc_id, b, any_value(t) AS t, -sum(n / t * log2(n / t)) AS e FROM c JOIN t USING (doc_id, b) GROUP BY doc_id, b) SELECT doc_id, round(sum(t * e) / sum(t), 6) + {d(0.0)} AS block_entropy FROM e GROUP BY doc_id UNION ALL SELECT doc_id, {d(0.0)} FROM documents WHERE coalesce(text, '') = ''")
def block_entropy(spark, path):
    return S.entropies(docs(spark, path), "doc_id", text(), BLOCK).select("doc_id", (F.round("block_entropy", 6) + 0.0).alias("block_entropy"))


TOY = f"toy AS (SELECT k, s AS sym, CASE WHEN s = p THEN 3841 ELSE 1 END AS freq FROM (SELECT CAST(unnest(range(0, 2)) AS INTEGER) AS k, unnest([{PEAKS[0]}, {PEAKS[1]}]) AS p), (SELECT CAST(unnest(range(0, 256)) AS INTEGER) AS s))"


def toy_rows(spark):
    return spark.range(256).select(F.col("id").cast("int").alias("sym")).select(F.posexplode(F.array(*[F.lit(p) for p in PEAKS])).alias("k", "p"), "sym").select("k", "sym", F.when(F.col("sym") == F.col("p"), 3841).otherwise(1).alias("freq"))


def lengths():
    return F.when(F.col("freq") > 0, 12 - F.log2(F.col("freq").cast("double"))).otherwise(F.lit(E.MISSING))


@query(f"WITH {TOY} SELECT k, sym, round(12 - log2(freq), 9) AS bits FROM toy")
def codelengths(spark, path):
    return toy_rows(spark).select("k", "sym", F.round(lengths(), 9).alias("bits"))


@query(f"WITH {TOY}, {BYTES}, c AS (SELECT doc_id, pos // {BLOCK} AS block, byte, count(*) AS n FROM y GROUP BY ALL), s AS (SELECT doc_id, block, k, sum(n * (12 - log2(freq))) AS cost FROM c JOIN toy ON byte = sym GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY round(cost, 6), k) AS rn FROM s) SELECT doc_id, CAST(block AS BIGINT) AS block, k, round(cost, 6) AS cost FROM r WHERE rn = 1")
def table_select(spark, path):
    """The cheapest table of each block: histograms meet 512 code lengths (a fixed broadcast), sums by block and table, least of them."""
    h = S.block_histograms(docs(spark, path), "doc_id", text(), BLOCK)
    costs = h.join(F.broadcast(toy_rows(spark).select("k", "sym", lengths().alias("bits"))), F.col("byte") == F.col("sym")).groupBy("doc_id", "block", "k").agg(F.round(F.sum(F.col("n") * F.col("bits")), 6).alias("cost"))
    return costs.groupBy("doc_id", "block").agg(F.min(F.struct("cost", "k")).alias("m")).select("doc_id", "block", "m.k", "m.cost")


@query(f"""WITH {TOY}, {BYTES}, c AS (SELECT doc_id, pos // {BLOCK} AS block, byte, count(*) AS n FROM y GROUP BY ALL), t AS (SELECT doc_id, block, sum(n) AS t, -sum(n * log2(n)) + sum(n) * log2(sum(n)) AS least FROM c GROUP BY ALL),
s AS (SELECT doc_id, block, k, sum(n * (12 - log2(freq))) AS cost FROM c JOIN toy ON byte = sym GROUP BY ALL), m AS (SELECT doc_id, block, min(cost) AS cost FROM s GROUP BY ALL)
SELECT doc_id, CAST(sum(t) AS BIGINT) AS n_bytes, round(sum(cost - least) / sum(t), 6) AS gap FROM m JOIN t USING (doc_id, block) GROUP BY doc_id""")
def xent_gap(spark, path):
    """Bits a byte that the best of the given tables takes above each block's own entropy, by section."""
    import numpy as np

    bits = 12 - np.log2(np.array(toy(), dtype=np.float64))

    def fn(parts):
        out = []
        for p in parts:
            h = E.block_histograms(p, BLOCK).astype(np.float64)
            n = h.sum(1)
            least = (h * np.log2(np.where(h > 0, n[:, None] / np.maximum(h, 1), 1))).sum()
            out.append([{"n_bytes": len(p), "gap": round(float(((h @ bits.T).min(1).sum() - least) / len(p)), 6)}] if p else [])
        return out

    return S.map_sections(docs(spark, path), "doc_id", text(), fn, "n_bytes long, gap double")


@query(f"WITH {TOY}, e AS (SELECT k, sym, unnest(range(0, freq)) AS i, freq FROM toy), o AS (SELECT k, sym, row_number() OVER (PARTITION BY k ORDER BY sym, i) - 1 AS n FROM e) SELECT k, CAST(n * 2563 % 4096 AS BIGINT) AS slot, sym FROM o")
def tans_spread(spark, path):
    """Slot of every occurrence by its closed form."""
    before = F.coalesce(F.sum("freq").over(Window.partitionBy("k").orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    occ = toy_rows(spark).withColumn("before", before).select("k", "sym", "before", F.explode(F.sequence(F.lit(0), F.col("freq") - 1)).alias("i"))
    return occ.select("k", ((F.col("before") + F.col("i")) * 2563 % 4096).cast("long").alias("slot"), "sym")


DOC_OK = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, true AS same FROM documents"


def there_and_back(spark, path, method, planar=False, tables=None, **kw):
    """Each text through a coder and back, in one pass: stored as it pays, decoded, compared."""
    code, kw = {"rans": E.RANS, "tans": E.TANS}[method], kw | ({"tables": tables, "embed": False} if tables else {})

    def fn(parts):
        stored = (E.pack_planar if planar else E.pack)(parts, code, **kw)
        back = (E.unpack_planar if planar else E.unpack)(stored, tables)
        return [[{"n_bytes": len(p), "same": not isinstance(x, E.CorruptSection) and bytes(x) == p}] for p, x in zip(parts, back, strict=True)]

    return S.map_sections(docs(spark, path), "doc_id", text(), fn, "n_bytes long, same boolean")


@query(DOC_OK)
def rans_roundtrip(spark, path):
    return there_and_back(spark, path, "rans")


@query(DOC_OK)
def tans_roundtrip(spark, path):
    return there_and_back(spark, path, "tans", block=512)


@query(DOC_OK)
def tans_dict_roundtrip(spark, path):
    tables = S.learn_dictionary(docs(spark, path), "doc_id", text(), 4, 512)
    return there_and_back(spark, path, "tans", tables=tables, block=512)


@query(DOC_OK)
def planar_roundtrip(spark, path):
    return there_and_back(spark, path, "rans", planar=True)


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, true AS same FROM embeddings")
def rice_roundtrip(spark, path):
    import numpy as np

    import pyarrow as pa

    def run(batches):
        for b in batches:
            vs = [np.array(v.values.to_numpy()) for v in b.column(1)]
            yield pa.record_batch({"vec_id": b.column(0), "n": pa.array([len(v) for v in vs], pa.int64()), "same": pa.array([bool((E.rice_decode(E.rice_encode(v)) == v).all()) for v in vs])})

    q = F.flatten(F.transform("code", lambda b: b["q"]))
    return sym(spark, path).select(F.col("vec_id").cast("long"), q.alias("q")).mapInArrow(run, "vec_id long, n long, same boolean")


ZZ = f"{sql_values(sql_sym())}, z AS (SELECT vec_id, CAST(CASE WHEN q < 0 THEN -2 * q - 1 ELSE 2 * q END AS BIGINT) AS u FROM v0)"


@query(f"WITH {ZZ} SELECT vec_id, CAST(sum(u) AS BIGINT) AS sum_u, max(u) AS max_u FROM z GROUP BY vec_id")
def zigzag(spark, path):
    u = F.transform(F.flatten(F.transform("code", lambda b: b["q"])), lambda v: F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 31)))
    return sym(spark, path).select("vec_id", F.aggregate(u, F.lit(0), lambda a, v: a + v).cast("long").alias("sum_u"), F.array_max(u).cast("long").alias("max_u"))


@query(f"WITH {ZZ}, kk AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS k), cc AS (SELECT vec_id, k, CAST(sum((u >> k) + 1 + k) AS BIGINT) AS bits FROM z, kk GROUP BY vec_id, k) SELECT vec_id, k, bits, row_number() OVER (PARTITION BY vec_id ORDER BY bits, k) = 1 AS best FROM cc")
def rice_cost_by_k(spark, path):
    u = F.transform(F.flatten(F.transform("code", lambda b: b["q"])), lambda v: F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 31)))
    costs = [F.struct(F.lit(k).alias("k"), F.aggregate(F.transform("u", (lambda s: lambda v: F.shiftright(v, s) + 1 + s)(k)), F.lit(0).cast("long"), lambda a, v: a + v).alias("bits")) for k in range(5)]
    rows = sym(spark, path).select("vec_id", u.alias("u")).select("vec_id", F.array(*costs).alias("c"))
    best = F.array_min(F.transform("c", lambda x: F.struct(x["bits"].alias("bits"), x["k"].alias("k"))))["k"]
    return rows.select("vec_id", best.alias("b"), F.explode("c").alias("c")).select("vec_id", "c.k", "c.bits", (F.col("c.k") == F.col("b")).alias("best"))


@query()
def entropy_gate(spark, path):
    """Sections that coding shrinks by 8 % and more, by both coders."""
    src = docs(spark, path)
    one = lambda m, **kw: S.coded(src, "doc_id", text(), m, **kw).select("doc_id", F.lit(m).alias("coder"), "method", "raw_len", F.octet_length("blob").cast("long").alias("stored"))
    return one("rans").unionByName(one("tans", block=512))


@query()
def coder_efficiency(spark, path):
    """Stored bits a byte of both coders beside the entropy bound, by language: one pass over the texts. A text without bytes has no ratio, a language without bytes no bits a byte."""

    def fn(parts):
        rans, tans = ([len(b) for _, b in E.pack(parts, code, **kw)] for code, kw in ((E.RANS, {}), (E.TANS, {"block": 512})))
        return [[{"n_bytes": len(p), "shannon": S.bits_per_byte(E.histogram(p)) if p else 0.0, "rans": r, "tans": t}] for p, r, t in zip(parts, rans, tans, strict=True)]

    j = S.map_sections(scan(spark, path, "documents", "lang", "text"), "lang", text(), fn, "n_bytes long, shannon double, rans long, tans long")
    per = lambda c: F.round(F.try_divide(8 * F.sum(c), F.sum("n_bytes")), 6)
    return j.groupBy("lang").agg(F.sum("n_bytes").alias("n_bytes"), per("rans").alias("rans_bits"), per("tans").alias("tans_bits"), F.round(F.try_divide(F.sum(F.col("shannon") * F.col("n_bytes")), F.sum("n_bytes")), 6).alias("bound_bits"), F.round(F.avg((F.col("tans") < F.col("rans")).cast("double")), 6).alias("tans_wins"), F.percentile(F.try_divide("tans", "rans"), F.lit(0.5)).alias("p50"))


@query(f"""WITH {BYTES.replace("SELECT doc_id, hex", "SELECT doc_id, coalesce(lang, '') AS lang, hex").replace("SELECT doc_id, i - 1", "SELECT lang, doc_id, i - 1").replace("SELECT doc_id, x, unnest", "SELECT lang, doc_id, x, unnest")},
c AS (SELECT lang, byte, count(*) AS n FROM y GROUP BY lang, byte), f AS (SELECT lang, byte, least(4096, greatest(1, n * 4096 // CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT))) AS f FROM c),
o AS (SELECT *, 4096 - CAST(sum(f) OVER (PARTITION BY lang) AS BIGINT) AS rest, row_number() OVER (PARTITION BY lang ORDER BY f DESC, byte) AS k, lead(f) OVER (PARTITION BY lang ORDER BY f DESC, byte) AS second FROM f)
SELECT lang, byte, CAST(CASE WHEN k > 1 THEN f WHEN f + rest >= coalesce(second, 0) THEN f + rest ELSE NULL END AS BIGINT) AS freq FROM o""")
def table_normalize(spark, path):
    """Integer frequencies of each language's bytes, with a sum of 4096."""
    src = spark.read.parquet(f"{path}/documents.parquet").select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    parts = S.map_sections(src, "lang", text(), lambda ps: [[{"byte": int(b), "n": int(h[b])} for b in h.nonzero()[0]] for h in map(E.histogram, ps)], "byte int, n long")
    counts = parts.groupBy("lang", "byte").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("byte", "n")).alias("h"))  # at most 256 pairs a language

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for lang, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.zeros(256, np.int64)
                for p in pairs:
                    c[p["byte"]] = p["n"]
                f = E.normalize(c)
                used = np.flatnonzero(f)
                yield pa.record_batch({"lang": pa.array([lang] * len(used)), "byte": pa.array(used, pa.int32()), "freq": pa.array(f[used], pa.int64())})

    return counts.mapInArrow(run, "lang string, byte int, freq long")
