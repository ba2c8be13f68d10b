"""Cases that only larger tables hold."""

import duckdb
import numpy as np

from tesserae.functions import search as S
from tesserae.functions import wavelet as W
from tesserae.operators import images, sections
from tesserae.plans import catalog


def test_bf16_rounds_once():
    half = 1 + 2.0**-8
    x = np.array([half, half + 2.0**-40, half + 2.0**-7, half + 2.0**-7 - 2.0**-40, -half - 2.0**-40])
    assert S.bf16(x).tolist() == [1.0, 1 + 2.0**-7, 1 + 2.0**-6, 1 + 2.0**-7, -1 - 2.0**-7]


def test_scales_near_half_way(spark, tmp_path):
    """Winning scales whose single is a half way point of the 16-bit grid, and whose double is not."""
    vectors = [[0.8992462754249573, 0.2781980037689209, 0.21623769402503967], [0.1161164864897728, 0.588742196559906, 0.21038442850112915], [0.7179332971572876, 0.29045969247817993, 0.12587501108646393]]
    spark.createDataFrame([(i, 0, v) for i, v in enumerate(vectors)], "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.sql(catalog.oracle_sql()["adaptive_int8"])
    got = catalog.queries()["adaptive_int8"](spark, f"file://{tmp_path}").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_coders_by_language(spark, tmp_path):
    """Texts without bytes, null ones, and ids that repeat."""
    rows = [(1, "abcab " * 40, "en"), (1, "", "en"), (None, "x" * 700, "en"), (2, None, "fr"), (3, "", "fr"), (4, "noir et blanc " * 9, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.lang: r for r in catalog.queries()["coder_efficiency"](spark, f"file://{tmp_path}").collect()}
    assert {k: r.n_bytes for k, r in got.items()} == {"en": 940, "fr": 0, None: 126}
    assert got["fr"].rans_bits is None and got["fr"].p50 is None and got["fr"].tans_wins == 0
    assert 0 < got["en"].rans_bits < 8 and got["en"].p50 > 0


def test_long_sections_go_with_few():
    lengths = np.array([3] * 300 + [1 << 24] * 3 + [1 << 26] + [3] * 5)
    cut = list(sections.runs(lengths))
    assert [a for a, _ in cut] == np.cumsum([0, *(n for _, n in cut)])[:-1].tolist() and sum(n for _, n in cut) == len(lengths)
    assert all(n <= sections.BATCH and (n == 1 or lengths[a:a + n].max() * n <= sections.PADDED) for a, n in cut)
    assert list(sections.runs(lengths[:0])) == []


def test_images_are_decoded_together(monkeypatch):
    """Decoding takes one pass for all images of a batch, not one for each."""
    a = np.concatenate([np.random.default_rng(0).integers(0, 256, (9, 17, 33, 3)), np.full((3, 17, 33, 3), 7)]).astype(np.uint8)
    coded, half = W.adaptive_encode(a, "balanced")
    want = W.adaptive_decode(coded, half, 17, 33)
    for c, level, b in W.order(half):
        p = coded[c][level, b][0]
        streams = W.sparse_pack_all(p)
        assert streams == [W.sparse_pack(x) for x in p]
        assert (W.sparse_unpack_all(streams, *p.shape[1:]) == p).all()
    calls, decode = [], W.adaptive_decode
    monkeypatch.setattr(W, "adaptive_decode", lambda *x: calls.append(1) or decode(*x))
    for method in ("none", "rans", "tans"):
        assert (np.stack(images.xs_decode(images.xs_encode(a, "balanced", method), half, 17, 33)) == want).all()
    assert len(calls) == 3
