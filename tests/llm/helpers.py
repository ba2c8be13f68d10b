"""Small tables with every awkward row, and brute-force versions of the operators."""

import contextlib
import random
import re
from pathlib import Path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, vocabulary=400):
    return " ".join(f"w{int(r.paretovariate(0.6)) % vocabulary}x{r.randrange(3)}" for _ in range(n))


def documents(spark, rows=None, schema=DOCS):
    return spark.createDataFrame(rows if rows is not None else awkward(), schema)


def awkward(seed=0, n=60):
    """Nulls in every column, empty and blank texts, exact and near copies, repeated ids aside, one very long text."""
    r = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        t = prose(r, r.choice([1, 2, 3, 5, 40, 120, 300]))
        if texts and r.random() < 0.35:
            words = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 0, 1, 2])):
                words[r.randrange(len(words))] = "EDIT"
            t = " ".join(words)
        texts.append(t)
        rows.append((i, t, r.choice(["en", "fr", None]), r.choice(["a", "a", "a", "b", None]), len(t)))
    rows += [(n, None, "en", "a", None), (n + 1, "", "en", "b", 0), (n + 2, " \n\t ", None, None, 4), (n + 3, "...", "fr", "b", 3), (n + 4, prose(r, 20_000), "en", "a", None), (n + 5, None, None, None, None)]
    return rows


def words(text):
    return (text or "").encode().lower().split()


def marks(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near_components(rows, k, percent):
    """id -> smallest id reachable by links of shingle sets; rows (id, text), ids not null."""
    ids = [i for i, _ in rows]
    sets = [shingles(t, k) for _, t in rows]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@contextlib.contextmanager
def many_partitions(spark, n=64):
    """Shuffles have n partitions, and Spark merges none; yields a function that counts the files checkpointed meanwhile."""
    from tesserae.llm.common import shared_dir

    at = Path(re.sub("^file:/*", "/", shared_dir(spark)))
    files = lambda: set(at.glob("**/rdd-*/part-*"))
    own, before = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}, files()
    old = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield lambda: len(files() - before)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
