"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra
columns with clashing names: every operator gives its stated result."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, html_text, langid, licenses, mixing, packing, pii, secret_scan, simhash, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, fp string, size string, row_ string"
LONG = "una casa de la ciudad " * 20000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "The house and the tree", "en", "b"),
            (4, "The house and the tree", "en", "b"), (5, "The house and the tree", "en", None), (None, "x y z w", None, "c"),
            (None, "x y z w", None, "c"), (None, None, None, None), (8, LONG, "es", "b"), (9, "1234 !!", "en", "a"),
            (10, "la casa de la ciudad es grande", "es", "a"), (11, "Grüße aus München \U0001F600 und Köln", "de", "c")]
    rows += [(20 + i, f"the quick brown fox number {'abc'[i % 3]} runs over there", "en", "b") for i in range(30)]
    return spark.createDataFrame([(*r, 0, 7, "c1", "c2", "c3") for r in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df, col="doc_id"):
    return sorted((r[col] for r in df.select(col).collect()), key=lambda x: (x is None, x))


def test_mixing(docs, empty):
    rows = mixing.mix_plan(docs).collect()
    assert len(rows) == docs.count()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += r.size
    assert all(r.source_size == size[r.source] and r.copies in (0, 1, 2) and r.target <= 2 * r.source_size for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(size.values())) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_plan(docs).collect()))
    twice = [r.copies for r in rows if r.doc_id == 4]
    assert len(set(twice)) == 1
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_sources(empty).count() == 0


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 300)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # a (weight 3) and c (2) stop at 20; b (1) and null (3) share 1980 - 40: null stops at 600
    assert got == {"a": 20.0, "c": 20.0, None: 600.0, "b": 1340.0}


def test_exact_dedup(docs, empty):
    rows = exact_dedup.classify(docs).collect()
    assert len(rows) == docs.count()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    for g in groups.values():
        assert all(r.group_size == len(g) for r in g) and sum(r.kept for r in g) == 1
        known = [r.doc_id for r in g if r.doc_id is not None]
        assert {r.keep_id for r in g} == {max(known) if known else None}
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and ids(kept) == ids(docs.sparkSession.createDataFrame(
        [(r.doc_id,) for r in rows if r.kept], "doc_id long"))
    assert exact_dedup.classify(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_round_trip(n):
    rng = np.random.default_rng(n)
    low = 1 << 40
    v = np.unique(rng.integers(low, low + (1 << 38), n))
    again = rng.random(len(v)) < 0.3
    got, bits = exact_dedup.golomb_decode(exact_dedup.golomb_encode(v, low, again), low)
    assert (got == v).all() and (bits == again).all()


def test_golomb_dense():
    v = np.arange(100, 5000)
    got, _ = exact_dedup.golomb_decode(exact_dedup.golomb_encode(v, 100, np.zeros(len(v), bool)), 100)
    assert (got == v).all()


def test_scans_keep_every_row(docs, empty):
    for scan in (pii.find_pii, secret_scan.find_secrets, licenses.scan_licenses):
        assert ids(scan(docs)) == ids(docs) and scan(empty).count() == 0


def test_simhash(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r.fp for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert ids(kept) == sorted({r.component_id for r in rows if r.component_id is not None}) + \
        [None] * len({r.fp for r in rows if r.component_id is None})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


def test_language_id(docs, empty):
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    und = {1, 2, 3, 9}
    assert all((r.lang_pred == "und") == (r.doc_id in und or r.doc_id is None and r.score == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not und & set(ids(kept))
    assert langid.identify(empty).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, limit=64).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    check_sequences(rows, 64)
    assert packing.pack(empty).count() == 0
    with_ids = packing.pack(docs.where("doc_id = 2"), with_ids=True).first()
    assert with_ids.ids == [1] and with_ids.ids_crc32 == zlib.crc32((1).to_bytes(4, "little"))


def check_sequences(rows, limit):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= limit


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]),
            (None, [1.0, 1.0]), (7, []), (8, [3.0]), (100, [-1.0, 0.5]), (9, [1.0, 2.0, 5.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, v string")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=3).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    m = 1024 * 1024
    assert by[0] == [(1, 0, 5 * m), (2, 1, 5 * m), (3, 9, 5 * m)]
    assert by[100][0] == (1, 0, 0) and len(by[100]) == 3
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_beyond_doubles(spark):
    rows = [(0, [1e9, 3.0]), (1, [1e9, 2.0]), (2, [1e9, 5.0]), (3, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.top_k(df, F.col("vec_id") == 0).collect()}
    big = (10 ** 9 * 1024) ** 2
    assert got == {1: min(big + 6 * 1024 ** 2, topk.LONG_MAX), 2: min(big + 15 * 1024 ** 2, topk.LONG_MAX), 3: topk.LONG_MAX}


def test_html(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<article><p>a &amp; b</p><p> c\n d</p></article><footer>x</footer>"),
             (3, None, "<article><p>a &amp; b</p><p> c\n d</p></article><footer>x</footer>"),
             (4, "u", "<article>" + "<p>word word</p>" * 5000), (None, "u", "<article><!-- cut <p>never")]
    df = spark.createDataFrame([(*p, "t", 3) for p in pages], "page_id long, url string, html string, text string, n_chars long")
    rows = html_text.extract(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 6 and got[1] == got[2] == got[None] == "" and got[3] == "a & b\nc d"
    assert got[4] == "\n".join(["word word"] * 5000)
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_reads_on_after_icons_and_unclosed_media():
    text = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert text("<article><p>a<svg class='i' viewBox='0 0 1 1'/></p><p>b</p></article><p>c</p>") == ["a", "b", "c"]
    assert text("<article><svg><style/><path d='x'/><text>no</text></svg><p>b</p><svg/><p>c</p></article>") == ["b", "c"]
    for tag in ("select", "object", "video", "audio", "canvas"):
        assert text(f"<article><{tag}><p>a</p><p>b</p><{tag}><p>no</p></{tag}><p>c</p></article><p>d</p>") == ["a", "b", "c", "d"]
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><math/><p>b</p>") == ["so x=1 holds", "b"]
    assert text("<video><p>no</p></video><p>b</p><script>'<p>'") == ["b"]
