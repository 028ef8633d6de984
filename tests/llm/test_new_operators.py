"""MinHash near-dedup, embedding whitening, hard negatives: against brute force, and their edge cases."""

import itertools
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash, negatives, queries, whitening
from tessera.llm.common import ascii_lower
from tessera.sources.tables import read

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# ---- minhash ----------------------------------------------------------------

def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def plain_components(rows):
    """doc_id -> smallest doc_id over links of at least 0.85, by all pairs of distinct sets."""
    by = defaultdict(list)
    for i, t in rows:
        by[shingles(t)].append(i)
    sets = list(by)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(sets)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = defaultdict(list)
    for k, s in enumerate(sets):
        least[find(k)] += [i for i in by[s] if i is not None]
    out = {}
    for k, s in enumerate(sets):
        for i in by[s]:
            out[i] = (min(least[find(k)]) if s and least[find(k)] else i, len(s))
    return out


def varied(rng, n):
    """Texts of their own, families whose members drift from one base, chains, boilerplate and copies."""
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 120))) for _ in range(n)]
    passage = " ".join(rng.choices(words, k=70))
    texts += [passage + " " + " ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(n)]
    base = rng.choices(words, k=150)
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    chain = rng.choices(words, k=100)
    for _ in range(20):
        chain = chain[3:] + rng.choices(words, k=3)
        texts.append(" ".join(chain))
    return texts + rng.choices(texts, k=n // 2) + ["a b c", "A  b\tC", "a b c d e f g", "a b c d e f g h"]


def test_minhash_components_match_all_pairs(spark):
    rng = random.Random(5)
    rows = list(enumerate(varied(rng, 150), 1000))
    rng.shuffle(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (component, size) in plain_components(rows).items():
        assert (got[i].component_id, got[i].n_shingles, got[i].kept) == (component, size, i == component)


def test_stars_alone_would_lose_links(spark):
    """Two alike documents in a bucket whose center is like neither are still linked."""
    words = [f"w{i}" for i in range(400)]
    center, twin = " ".join(words[:200]), " ".join(words[20:220])
    rows = [(1, center), (2, twin), (3, " ".join(words[20:218]) + " other")]
    sets = [(i, len(h), [7, i], [int(x) for x in h.view(np.int64)]) for (i, _), h in
            zip(rows, minhash.shingle_sets([t.encode() for _, t in rows]))]
    df = spark.createDataFrame(sets, "rep long, n long, bands array<long>, hashes array<long>")
    found = minhash.similar_components(minhash.shared_buckets(df), df.select("rep", "hashes")).collect()
    assert {(r.node, r.root) for r in found} == {(2, 2), (3, 2)}


@pytest.mark.parametrize("small", [16, 1000])
def test_blocks_lose_no_link(spark, monkeypatch, small):
    """One bucket of 300 documents with few links, cut into many cells."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts, base = [], rng.choices(words, k=60)
    for _ in range(300):
        copy = list(rng.choice(texts[-40:]).split()) if texts and rng.random() < .6 else list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts = list(dict.fromkeys(texts))
    sets = minhash.shingle_sets([t.encode() for t in texts])
    df = spark.createDataFrame([(i, len(h), [7], [int(x) for x in h.view(np.int64)]) for i, h in enumerate(sets)],
                               "rep long, n long, bands array<long>, hashes array<long>")
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 40)
    monkeypatch.setattr(minhash, "SMALL", small)
    found = minhash.similar_components(minhash.shared_buckets(df), df.select("rep", "hashes"))
    got = {r.node: r.root for r in found.collect()}
    want = {i: c for i, (c, _) in plain_components(list(enumerate(texts))).items()}
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) > 50


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    rng = np.random.default_rng(2)
    a, b = ([np.unique(rng.integers(0, 200, n)) for n in (0, 3, 50, 120)] for _ in range(2))
    assert (minhash.shared_counts(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_densified_bins_agree_as_sets_do():
    rng = np.random.default_rng(4)
    missed, agree = 0, []
    for size in (6, 12, 40, 200, 3000):
        for _ in range(150):
            same = rng.integers(0, 1 << 64, int(np.ceil(size * .86)), dtype=np.uint64)
            a = np.unique(np.r_[same, rng.integers(0, 1 << 64, size - len(same), dtype=np.uint64)])
            b = np.unique(same)
            x, y = minhash.one_permutation([a, b])
            agree.append((x == y).mean() - len(b) / len(a))
            missed += not np.equal(*minhash.band_keys(np.stack([x, y]))).any()
    assert not missed and abs(np.mean(agree)) < .01


def test_one_permutation_fills_every_bin():
    for n in (1, 2, 5):
        h = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
        assert set(minhash.one_permutation([h])[0]) <= set(h)
    one = np.array([5], np.uint64)
    assert (minhash.one_permutation([one]) == one).all() and minhash.one_permutation([]).shape == (0, minhash.BINS)


def test_minhash_edges(spark):
    schema = "doc_id long, text string, rid long, n string, bands string"
    long = "una casa de la ciudad " * 20000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x y"), (4, "x y"), (None, "x y"), (5, "X Y"), (6, long), (7, long + "fin"),
            (None, "only null here"), (8, "\x1cx y"), (9, "x y")]
    df = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], schema)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert all(by[i] == {(0, i, True)} for i in (1, 2, 3))
    assert by[4] == {(1, 4, True)} and by[5] == by[9] == {(1, 4, False)} and by[8] == {(1, 8, True)}
    assert by[None] == {(1, 4, False), (1, None, True)}
    assert by[6] == {(5, 6, True)} and {r.component_id for r in got if r.doc_id == 7} == {7}   # 5 of 6 or 10 shingles
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_op11_query_is_the_operator(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    want = plain_components(rows)
    got = queries.QUERIES["op11_minhash"](spark, SF)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got.collect()} == want


# ---- whitening --------------------------------------------------------------

def determinant(m):
    m, out = [[Fraction(v) for v in row] for row in m], Fraction(1)
    for k in range(len(m)):
        r = next((i for i in range(k, len(m)) if m[i][k]), None)
        if r is None:
            return 0
        if r != k:
            m[k], m[r], out = m[r], m[k], -out
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k])]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_characteristic_polynomial(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-10 ** 6, 10 ** 6, (9, 7)).astype(object)
    if seed == 1:
        x[:, 3:] = 0                                    # rank 3
    m = (x.T @ x).tolist()
    if seed == 2:
        m = np.diag([5, 5, 0, 9, 9, 9, 1]).tolist()     # nothing to reduce
    c = whitening.characteristic(spark, m)
    for at in (-3, 0, 2, 10 ** 5):
        assert sum(v * at ** k for k, v in enumerate(c)) == determinant(
            [[(at if i == j else 0) - m[i][j] for j in range(7)] for i in range(7)])
    if seed == 2:
        assert [(round(r), n) for r, n in whitening.largest_roots(c, 7)] == [(9, 3), (5, 2), (1, 1)]
        assert whitening.roots_above(c, 5, 0) == 3 and whitening.roots_above(c, 11, 1) == 3


def test_primes():
    found = whitening.primes(200)
    assert found[0] == 2 ** 31 - 1 and len(set(found)) == len(found) and all(p % q for p in found for q in range(2, 2000))


def check_whitened(rows, vectors, k):
    """vectors: (vec_id, whole numbers), the usable ones."""
    x = np.array([v for _, v in vectors], float)
    fit = np.unique(x, axis=0)
    n = len(fit)
    value, vector = np.linalg.eigh((fit - fit.mean(0)).T @ (fit - fit.mean(0)) / n)
    value, vector = value[::-1], vector[:, ::-1]
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - value[r.component - 1] / value.sum()) < 1e-9
    for c in range(1, k + 1):
        want = (x - fit.mean(0)) @ vector[:, c - 1] / np.sqrt(value[c - 1])
        mine = np.array([got[i][c].whitened for i, _ in vectors])
        assert min(abs(want - mine).max(), abs(want + mine).max()) < 1e-7
    total = [int(v) for v in fit.sum(0)]
    for i, v in vectors:
        assert got[i][1].deviation == sum((n * int(a) - s) ** 2 for a, s in zip(v, total))


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, [3, .2, .2001, 1, .01, 2], (300, 6))
    x = np.r_[x, x[:40]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    out = whitening.whiten(df).collect()
    assert len(out) == 4 * len(rows)
    check_whitened(out, [(i, np.floor(256 * np.array(v))) for i, v in rows], 4)
    again = whitening.whiten(df.repartition(3)).collect()
    assert sorted(str(r[:-1]) for r in again) == sorted(str(r[:-1]) for r in out)    # the error's last digits follow the order of adding


def test_op12_query(spark):
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, float))) for r in read(spark, SF, "embeddings").collect()]
    check_whitened(queries.QUERIES["op12_whitening"](spark, SF).collect(), rows, 4)


def test_equal_eigenvalues(spark):
    """Points on the axes at one distance: every direction has the same variance."""
    rows = [(2 * i + s, [float((2 * s - 1) * (i == j)) for j in range(5)]) for i in range(5) for s in (0, 1)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 40 and all(abs(r.explained - .2) < 1e-12 and r.identity_error < 1e-12 for r in out)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>, n string, x string, component string, rid int"
    def run(vectors):
        return whitening.whiten(spark.createDataFrame([(i, v, "a", "b", "c", 1) for i, v in vectors], schema)).collect()
    out = run([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [NAN, 1.0]), (5, [None, 1.0]), (6, [INF, 1.0]),
               (None, [3.0, 4.0]), (8, [1.0]), (9, [1.0, 0.0]), (10, [])])
    assert Counter(r.vec_id for r in out) == {i: 2 for i in (1, 2, None, 8, 9, 10)}
    assert {r.n for r in out} == {4}
    same = {i: sorted((r.component, r.whitened, r.deviation) for r in out if r.vec_id == i) for i in (1, 2, 8, 9)}
    assert same[1] == same[2] and same[8] == same[9]
    assert run([]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(1, [1.0]), (2, [1.0])]) == [] and run([(1, [])]) == []
    line = run([(i, [float(i), 2.0 * i, 0.0]) for i in range(6)])
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    huge = run([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 3.0])])
    assert len(huge) == 6 and {r.deviation for r in huge} == {None, (3 * 768 - 1024) ** 2}


# ---- hard negatives ---------------------------------------------------------

def plain_negatives(rows, positives=5, k=10):
    """rows: (vec_id, label, whole vector); anchors have ids divisible by 100."""
    out = []
    for i, (a, la, x) in enumerate(rows):
        if a % 100 or any(r == (a, la, x) for r in rows[:i]):
            continue
        score = [(-sum(p * q for p, q in itertools.zip_longest(x, y, fillvalue=0)), c, j, lc)
                 for j, (c, lc, y) in enumerate(rows) if j != i]
        near = sorted(s for s in score if s[3] == la)[:positives]
        for ps, p, *_ in near:
            fits = sorted(s for s in score if s[3] != la and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:k]
            out += [(a, p, r, s[1], -ps, -s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out)


def mined(df, **options):
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label"), **options).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


@pytest.mark.parametrize("width, options", [(16, {}), (13, {"anchor_block": 3, "pilot_rows": 64}), (64, {"levels": (1, 2, 8)})])
def test_negatives_match_brute_force(spark, width, options):
    rng = np.random.default_rng(width)
    center = rng.normal(0, 1, (4, width))
    rows = []
    for i in range(900):
        label = int(rng.integers(0, 4))
        v = center[label] + rng.normal(0, .7, width) if i % 9 else center[0]        # one very common vector
        rows.append((i if i % 11 else 500, label, np.floor(256 * v.astype(np.float32).astype(float)) / 256))
    df = spark.createDataFrame([(i, l, v.tolist()) for i, l, v in rows], "vec_id long, label int, embedding array<double>")
    want = plain_negatives([(i, l, tuple(int(x) for x in v * 256)) for i, l, v in rows])
    assert len(want) > 100 and mined(df.repartition(5), **options) == want


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    smooth = np.repeat(rng.integers(-200, 200, (60, 4)), 16, axis=1) + rng.integers(-3, 4, (60, 64))
    q, c = smooth[:20].astype(float), smooth[20:].astype(float)
    (qm, qd), (cm, cd) = negatives.summarize(q), negatives.summarize(c)
    score = q @ c.T
    need = np.full((20, 1), np.quantile(score, .9))
    alive = negatives.survivors(qm, qd, cm, cd, need, np.full((20, 1), np.inf), (1, 4, 16), np.ones(score.shape, bool))
    assert alive[score >= need].all() and alive.mean() < .2
    top = np.full((20, 1), np.quantile(score, .1))
    alive = negatives.survivors(qm, qd, cm, cd, np.full((20, 1), -np.inf), top, (1, 4, 16), np.ones(score.shape, bool))
    assert alive[score <= top].all() and alive.mean() < .2


def test_op13_query(spark):
    rows = []
    for r in read(spark, SF, "embeddings").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, tuple(int(np.floor(256 * float(x))) for x in r.embedding)))
    got = queries.QUERIES["op13_hard_negatives"](spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_negatives_edges(spark):
    schema = "vec_id long, label int, embedding array<double>, rid string, v string, anchor string, score int"

    def frame(rows):
        return spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], schema)
    rows = [(0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (1, 1, [2.0, 0.0]), (2, 1, [-1.0]), (3, 2, [0.5, 0.5]), (3, 2, [0.5, 0.5]),
            (4, 2, [0.25, 1.0]), (100, 9, [1.0, 0.0]), (200, 2, [])]
    bad = [(5, None, [1.0, 1.0]), (6, 1, None), (7, 2, [NAN, 1.0]), (8, 2, [None, 1.0]), (9, 2, [INF, 0.0]), (None, 2, [1.0, 1.0])]
    want = plain_negatives([(i, l, tuple(int(256 * x) for x in v)) for i, l, v in rows])
    assert want and mined(frame(rows + bad)) == want
    assert mined(frame([])) == [] and mined(frame([(0, 1, [])])) == [] and mined(frame([(1, 1, [1.0])])) == []


@pytest.mark.parametrize("big, stops", [(1e7, False), (1e9, True)])
def test_negatives_beyond_doubles(spark, big, stops):
    rows = [(0, 1, [big, 3.0]), (1, 1, [big, 0.0]), (2, 2, [big / 2, 1.0]), (3, 2, [big / 2, 2.0]), (4, 2, [big, 1.0]), (5, 2, [-big, 0.0])]
    got = mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    exact = plain_negatives([(i, l, tuple(int(256 * x) for x in v)) for i, l, v in rows])
    assert len(exact) == 2 and got == ([] if stops else exact)      # stopped scores are all alike: none below 90%


def test_minhash_shuffles_only_the_sets_that_pairs_ask_for(spark):
    """Round 3, op11: centers come first in a pair, and a side's sets are those of its classes alone."""
    members = spark.createDataFrame([(b, r, 10) for b in (1, 2) for r in range(30)], "bucket long, rep long, n long")
    pairs = minhash.stars(members).persist()
    assert pairs.count() == 29 and pairs.select("a").distinct().count() == 1
    again = minhash.more_stars(members.selectExpr("bucket", "rep", "n", "rep AS comp", "false AS main"))
    assert pairs.join(again, ["a", "b"], "left_anti").count() == 0 and again.count() == 30 * 29 / 2
    sets = spark.createDataFrame([(r, list(range(10))) for r in range(100)], "rep long, hashes array<long>")
    assert minhash.sets_of(pairs, "a", sets).count() == 1 and minhash.sets_of(pairs, "b", sets).count() == 29
    assert minhash.confirmed(pairs, sets).count() == 29
    twice = minhash.one_of_each(sets.union(sets.where("rep < 3")))
    assert sorted(r.rep for r in twice.collect()) == list(range(100))


def test_minhash_shuffles_no_bands_to_leave_copies_out(spark, tmp_path):
    """Round 3, op11: with joins by size off, as on large tables, the bands of the first rows are read where they lie."""
    rows = [(r, r % 40 if r < 60 else r, [r] * 64) for r in range(200)]
    spark.createDataFrame(rows, "rid long, key long, bands array<long>").write.parquet(f"{tmp_path}/prints")
    prints = spark.read.parquet(f"{tmp_path}/prints")
    classes = prints.groupBy("key").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("rows"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = minhash.first_rows(prints, classes)
        assert sorted(r.rid for r in first.collect()) == [r for r in range(200) if not 40 <= r < 60]
        plan = first._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
