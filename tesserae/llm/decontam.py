"""Benchmark decontamination: hashes of normalised word n-grams of the test items, looked up in every training text.

Every window of an item (GRAM words; a shorter item is one window) is hashed. The hashes go to all
tasks as one bit set of at most 2 ** MAX_BITS bits, a literal of the plan, whatever the number of
windows. A pass over each document hashes its windows by slices of its word hashes and tests them
against the bit set; only those that pass become rows (number, hash and the window's own words),
join the windows by hash (broadcast when their checked bytes allow, else shuffled, hot windows
apart) and are confirmed word by word. So rows follow the hits, false ones included, and not the
words; a bit set too small for its windows costs time and never results.

Defined results: null and empty texts have no words and no hits; items without words never occur;
repeated rows are judged one by one; repeated item ids count once; very long texts are one row like
others; an empty table gives an empty one, and with an empty benchmark nothing is hit; columns added
here are prefixed `dc_`, so others may have any other name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import MARKS, ascii_lower, checkpoint, few, let, split_words, spread_join, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GRAM = 10
#: Bits of the set for each window, and the base-2 logarithms of its least and greatest size (8 MB).
BITS_EACH, MIN_BITS, MAX_BITS = 64, 12, 26
#: Windows of up to so many bytes are broadcast; more are shuffled.
MAX_BROADCAST = 64 << 20
#: Documents whose results (spans and items included) are worth a task.
TASK_DOCS = 10_000


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), MARKS)


def hashed(words_of: Column) -> Column:
    return F.transform(words_of, lambda x: F.xxhash64(x))


def windows(benchmark: DataFrame, gram: int = GRAM) -> DataFrame:
    """(dc_h, dc_win, dc_ids): distinct windows with their hash and the items that hold them."""
    b = benchmark.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - gram, F.lit(0)))
    b = b.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(gram)))).alias("dc_win"))
    b = b.groupBy("dc_win").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("dc_ids"))
    return b.select(F.xxhash64(hashed(F.col("dc_win"))).alias("dc_h"), "dc_win", "dc_ids")


def bit_set(wins: DataFrame, n: int, max_bits: int = MAX_BITS) -> tuple[Column, int]:
    """The bits named by the leading bits of the hashes, as a literal array of longs, and how many bits lead."""
    bits = min(max(MIN_BITS, (n * BITS_EACH - 1).bit_length()), max_bits)
    place = F.shiftrightunsigned("dc_h", 64 - bits)
    own = wins.select(F.shiftrightunsigned(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    table = [0] * (1 << (bits - 6))
    for r in own.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():  # at most 2 ** (MAX_BITS - 6) rows
        table[r.at] = r.bits
    return F.expr(f"cast(split('{','.join(map(str, table))}', ',') as array<bigint>)"), bits


def union_length(spans: Column) -> Column:
    """Number of words in the union of sorted struct<s,e> spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["e"] - F.greatest(s["s"], a["at"]), F.lit(0))).alias("n"), F.greatest(a["at"], s["e"]).alias("at"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def possible(w: Column, sizes: list[int], table: Column, bits: int) -> Column:
    """Windows of the words w whose hash is in the bit set: array<struct<i,dc_h,win>>."""

    def of(hashes: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.expr("cast(array() as array<int>)"))
        tests = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i + 1, F.lit(n))))

        def look(h: Column, i: Column) -> Column:
            there = F.getbit(F.get(table, F.shiftrightunsigned(h, 64 - bits + 6).cast("int")), F.shiftrightunsigned(h, 64 - bits).bitwiseAND(F.lit(63)).cast("int")) == 1
            return F.when(there, F.struct(i.alias("i"), h.alias("dc_h"), F.slice(w, i + 1, F.lit(n)).alias("win")))

        return F.filter(F.transform(tests, look), lambda x: x.isNotNull())

    return let(hashed(w), lambda hashes: F.flatten(F.array(*[of(hashes, n) for n in sizes])))


def hits(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, max_bits: int = MAX_BITS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per input row: its columns but `text`, then dc_n_words, dc_spans (sorted struct<s,e>, distinct) and dc_items (sorted, distinct)."""
    most = benchmark.agg(F.sum(F.length("text").cast("long") + 1)).first()[0] or 0  # a window starts at a word, and a word takes two characters with what stands after it
    wins = checkpoint(few(windows(benchmark, gram), most // 2))
    width = F.aggregate(F.concat("dc_win", "dc_ids"), F.lit(64).cast("long"), lambda a, x: a + 32 + F.octet_length(x))
    n_wins, n_bytes, sizes = wins.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0)), F.sort_array(F.collect_set(F.size("dc_win")))).first()  # at most GRAM sizes
    keep = [c for c in docs.columns if c != "text"]
    none = F.expr("cast(array() as array<struct<i:int,dc_h:bigint,win:array<string>>>)")
    table, bits = bit_set(wins, n_wins, max_bits)
    seen = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), (possible(w, sizes, table, bits) if sizes else none).alias("near")))
    src = docs.select(F.monotonically_increasing_id().alias("dc_row"), F.struct(F.lit(0).alias("dc_"), *keep).alias("dc_keep"), seen.alias("dc_seen"))
    rows = src.select("dc_row", "dc_keep", F.col("dc_seen.n").alias("dc_n_words"), F.explode_outer("dc_seen.near").alias("dc_p"))
    rows = rows.select("dc_row", "dc_keep", "dc_n_words", F.col("dc_p.i").alias("dc_i"), F.col("dc_p.dc_h").alias("dc_h"), F.col("dc_p.win").alias("dc_own"))
    met = rows.join(F.broadcast(wins), "dc_h", "left") if n_bytes <= max_broadcast else spread_join(checkpoint(rows), wins.groupBy("dc_h").agg(F.collect_list(F.struct("dc_win", "dc_ids")).alias("dc_all")), "dc_h", "left").select(
        "*", F.explode_outer("dc_all").alias("dc_one")
    ).select("dc_row", "dc_keep", "dc_n_words", "dc_i", "dc_own", F.col("dc_one.dc_win").alias("dc_win"), F.col("dc_one.dc_ids").alias("dc_ids"))
    same = F.col("dc_own") == F.col("dc_win")
    span = F.when(same, F.struct(F.col("dc_i").alias("s"), (F.col("dc_i") + F.size("dc_win")).alias("e")))
    out = met.select("dc_row", "dc_keep", "dc_n_words", span.alias("dc_span"), F.when(same, F.col("dc_ids")).alias("dc_ids"))
    out = out.groupBy("dc_row").agg(
        F.first("dc_keep").alias("dc_keep"), F.first("dc_n_words").alias("dc_n_words"),
        F.sort_array(F.collect_set("dc_span")).alias("dc_spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("dc_ids")))).alias("dc_items"),
    )
    return out.select("dc_row", *([F.col("dc_keep")[c].alias(c) for c in keep]), "dc_n_words", "dc_spans", "dc_items")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of op6."""
    h = few(hits(docs.select("doc_id", "text"), benchmark), docs.count(), TASK_DOCS)
    n_hit = union_length(F.col("dc_spans")).cast("long")
    return h.select(
        "doc_id", F.col("dc_n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def merged(spans: Column) -> Column:
    """Disjoint spans from sorted ones."""
    zero = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        joins = (F.size(a) > 0) & (x["s"] <= F.when(F.size(a) > 0, last["e"]))
        grown = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(joins, grown).otherwise(F.concat(a, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    return F.aggregate(spans, zero, step)


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without the words in spans; each run of removed words leaves the separator before it."""

    def cut(gaps: Column, pieces: Column, gone: Column) -> Column:
        """pieces: each word with the separator before it."""
        part = lambda a, b: F.array_join(F.slice(pieces, a + 1, b - a), "")
        runs = F.transform(gone, lambda x, k: F.concat(part(F.when(k > 0, F.get(gone, k - 1)["e"]).otherwise(F.lit(0)), x["s"]), F.get(gaps, x["s"])))
        return F.concat(F.array_join(runs, ""), part(F.element_at(gone, -1)["e"], F.size(pieces)), F.element_at(gaps, -1))

    gaps, own = F.split(text, RAW_WORD, -1), F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))
    pieces = lambda g: F.zip_with(F.slice(g, F.lit(1), F.size(g) - 1), own, lambda x, w: F.concat(x, w))
    return let(gaps, lambda g: let(pieces(g), lambda p: let(merged(spans), lambda m: cut(g, p, m))))


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "document", gram: int = GRAM) -> DataFrame:
    """Remove contaminated documents (`document`) or the hit words only (`span`); columns as in docs.

    Only the keys of hit texts meet the documents again, so texts pass through no aggregation, and
    they stay where they are while Spark would broadcast those keys by their size.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode}")
    key = F.xxhash64("text")
    hit = hits(docs.select(F.col("doc_id").alias("dc_id"), key.alias("dc_key"), "text"), benchmark, gram).where(F.size("dc_spans") > 0)
    hit = stored(hit.groupBy("dc_id", "dc_key").agg(F.first("dc_spans").alias("dc_spans")), "hits")
    on = F.col("doc_id").eqNullSafe(F.col("dc_id")) & (key == F.col("dc_key"))
    if mode == "document":
        keys = hit.select("dc_id", "dc_key")
        return docs.join(keys.hint("shuffle_hash"), on, "left_anti")
    met = docs.join(hit, on, "left")
    text = F.when(F.col("dc_spans").isNull(), F.col("text")).otherwise(cut_spans(F.col("text"), F.col("dc_spans")))
    return met.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


SQL = f"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), bw AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + {GRAM - 1}) AS win, len(list_slice(w, i, i + {GRAM - 1})) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {GRAM - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), lens WHERE i + n - 1 <= len(w)
), m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
