"""Cases of the third round's findings."""

import math

from pyspark.sql import functions as F


def test_win_diff_divides_by_zero(spark, tmp_path):
    from tessera.plans.window_q import q_win_diff
    values = [0.0, 0.0, 4.0, 0.0, -2.0, 3.0]
    rows = [(k, k, 1, v) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, value double") \
        .withColumn("ts", F.timestamp_seconds("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.pct_change2 for r in q_win_diff(spark, str(tmp_path)).collect()}
    assert got[0] is None and got[1] is None
    assert got[2] == math.inf and math.isnan(got[3]) and got[4] == -1.5 and got[5] == math.inf


def test_word2vec_trains_in_several_partitions(spark, tmp_path, monkeypatch):
    from tessera.plans import ml_q
    spark.createDataFrame([(k, "a b c d e f") for k in range(60)], "doc_id long, text string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    used = []
    fit = ml_q.FT.Word2Vec.fit
    monkeypatch.setattr(ml_q.FT.Word2Vec, "fit", lambda self, df: used.append(self.getNumPartitions()) or fit(self, df))
    assert ml_q.q_text_word2vec(spark, str(tmp_path)).count() == 6
    monkeypatch.setattr(ml_q, "WORDS_PER_TRAINER", 100)
    assert ml_q.q_text_word2vec(spark, str(tmp_path)).count() == 6
    assert used == [1, 4]


def test_chi_square_of_many_values(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import ChiSquareTest

    from tessera.operators.chi import chi_square
    rows = [([float(k % 3), float(k), 0.0, float((k * k) % 5)], float(k % 2)) for k in range(10_500)]
    df = spark.createDataFrame(rows, "x array<double>, label double").withColumn("x", array_to_vector("x"))
    got = chi_square(df, "x", "label").orderBy("feature").collect()
    assert [r.degrees for r in got] == [2, 10_499, 0, 2] and abs(got[1].statistic - 10_500) < 1e-6
    small = df.limit(400)
    want = ChiSquareTest.test(small, "x", "label", flatten=True).orderBy("featureIndex").collect()
    for a, b in zip(chi_square(small, "x", "label").orderBy("feature").collect(), want):
        assert a.degrees == b.degreesOfFreedom and abs(a.statistic - b.statistic) < 1e-8 and abs(a.p_value - b.pValue) < 1e-10


def test_range_counts_form_no_pairs(spark):
    from tessera.operators.joins import range_counts, range_join
    pts = spark.createDataFrame([(v,) for v in [1.0, 1.0, 2.0, 3.0, 3.0, 7.5, None]], "v double")
    ivs = spark.createDataFrame([(1, 1.0, 3.0), (2, 2.0, 2.0), (2, 2.0, 2.0), (3, 4.0, 7.0), (4, 3.0, 9.0), (5, None, 3.0)],
                                "k long, lo double, hi double")
    got = range_counts(pts, "v", ivs, "lo", "hi")
    want = range_join(pts, "v", ivs.where("lo IS NOT NULL"), "lo", "hi", 2.0).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert got.groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect() == want.orderBy("k").collect()


def test_partitioned_edges_are_computed_once(spark, tmp_path):
    from tessera.operators.basket import boundary_nodes, export_partitioned_edges, partition_edges
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def once(x):
        seen.add(1)
        return x
    rows = [(w, a, a + b, 1, 1, 1, 0.5, 0.5) for w in range(2) for a in range(5) for b in (1, 2)]
    df = spark.createDataFrame(rows, "window_id int, i long, j long, cooc_count long, count_i long, count_j long, "
                                     "norm_score float, npmi float").withColumn("i", once.asNondeterministic()("i"))
    export_partitioned_edges(partition_edges(df), boundary_nodes, f"{tmp_path}/out")
    assert seen.value == len(rows)
    back = spark.read.parquet(f"{tmp_path}/out/edges")
    assert back.count() == len(rows) == spark.read.option("header", True).csv(f"{tmp_path}/out_csv/edges").count()
    want = boundary_nodes(partition_edges(back.drop("edge_partition", "i_partition", "j_partition")))
    assert sorted(spark.read.parquet(f"{tmp_path}/out/boundary_nodes").select("node", "partition").collect()) == sorted(want.collect())


def test_counted_pairs_are_the_marginals_of_every_pair(spark):
    from tessera.operators.basket import attach_marginals, cooccurrence, counted_pairs
    baskets = {1: [1, 2, 3], 2: [2, 3], 3: [1], 4: list(range(1, 9)), 5: [3, 4, None]}
    items = spark.createDataFrame([(o % 2, o, p) for o, ps in baskets.items() for p in ps],
                                  "window_id int, order_id long, product_id long")
    windows = spark.createDataFrame([(o, o % 2) for o in [*baskets, 6]], "order_id long, window_id int")
    columns = ["window_id", "i", "j", "cooc_count", "count_i", "count_j", "total_orders"]
    for hot in (3, 512):                # 3: order 4 takes the grid
        got = counted_pairs(items, windows, hot).select(*columns)
        want = attach_marginals(*cooccurrence(items, windows, hot)).select(*columns)
        by_pair = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines()
                   if "Exchange hashpartitioning(" in line and "i#" in line.split("hashpartitioning(")[1].split(", 8")[0]]
        assert len([x for x in by_pair if " j#" in x]) == 1
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 28


def _pair_exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "i#" in x.split("hashpartitioning(")[1]
            and " j#" in x.split("hashpartitioning(")[1]]


def test_pairs_are_shuffled_once_up_to_the_merged_graph(spark):
    from tessera.operators import basket as B
    from tessera.operators import community as C
    rows = [(o, p) for o in range(40) for p in range(o % 5 + 2)] + [(1, None), (None, 3)]
    op = spark.createDataFrame(rows, "order_id long, product_id long")
    windows = spark.createDataFrame([(o, o % 3 if o else None) for o in range(40)], "order_id long, window_id int")
    g = C.union_dedup(B.score_edges(B.counted_pairs(B.basket_items(op, windows), windows)), "norm_score")
    assert len(_pair_exchanges(g)) == 1
    assert g.count() == 15


def test_khop_and_distances_shuffle_the_edges_once(spark):
    from tessera.operators import community as C
    from tessera.operators import graph as G
    edges = [(k, k + 1, 1.0) for k in range(30)]
    kept = []
    seen = type(spark.range(1)).repartition
    import unittest.mock as mock
    with mock.patch.object(type(spark.range(1)), "repartition", lambda self, *a: kept.append(a) or seen(self, *a)):
        g = spark.createDataFrame(edges, "i long, j long, weight double")
        comm = spark.createDataFrame([(k, k) for k in range(31)], "node long, community long")
        region = C.khop_region(g, spark.createDataFrame([(5, 5)], "node long, community long"), comm, 2)
        dist = G.shortest_paths(spark.createDataFrame(edges, "src long, dst long, w double"), 0)
    assert kept == [("node",), ("src",)]
    assert sorted(r.node for r in region.collect()) == [3, 4, 5, 6, 7]
    assert {r.node: r.dist for r in dist.collect()} == {k: float(k) for k in range(31)}


def test_triangles_send_lists_not_wedges(spark, monkeypatch):
    from tessera.operators import graph as G
    from tessera.operators import iterate
    written = []
    write = iterate.write_table
    monkeypatch.setattr(iterate, "write_table", lambda df, tag="round": written.append(tag) or write(df, tag))
    edges = [(a, b) for a in range(9) for b in range(9) if (a * 7 + b * 3) % 4] + [(3, None), (20, 21)]
    got = {r.node: r.triangles for r in G.triangles(spark.createDataFrame(edges, "src long, dst long")).collect()}
    und = {(min(e), max(e)) for e in edges if None not in e and e[0] != e[1]}
    tri = [t for t in ((a, b, c) for a in range(9) for b in range(a + 1, 9) for c in range(b + 1, 9))
           if {(t[0], t[1]), (t[0], t[2]), (t[1], t[2])} <= und]
    assert tri and got == {v: sum(v in t for t in tri) for v in {x for t in tri for x in t}}
    assert written == ["triangle-lists"]


def test_pagerank_parts_grow_with_the_links(spark, monkeypatch):
    from tessera.operators import graph as G
    from tessera.operators import iterate
    monkeypatch.setattr(iterate, "ROWS_PER_TASK", 20)
    assert iterate.parts_for(spark, 1000) == 50 and iterate.parts_for(spark, 1) == 8
    links = [(a, (a * 3 + k) % 50) for a in range(50) for k in range(4)] * 2
    got = {r.node: r.rank for r in G.pagerank(spark.createDataFrame(links, "src long, dst long"), 3).collect()}
    rank = {a: 1.0 for a in range(50)}
    for _ in range(3):
        nxt = {}
        for a, b in set(links):
            nxt[b] = nxt.get(b, 0.0) + rank.get(a, 0.0) / 4
        rank = {b: 0.15 + 0.85 * x for b, x in nxt.items()}
    assert got.keys() == rank.keys() and all(abs(got[k] - rank[k]) < 1e-9 for k in rank)


def test_tf_idf_shuffles_texts_and_rare_words_only(spark, tmp_path, monkeypatch):
    from tessera.plans import ml_q
    docs = [(1, "a b a"), (2, "a c"), (2, "a c d"), (None, "b d d"), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(ml_q, "COMMON_TERMS", 3)        # a and b alone are common
    out = ml_q.q_text_tf_idf(spark, str(tmp_path))
    got = {(r.doc_id, r.term): (r.tf, r.tfidf) for r in out.collect()}
    tf = {(1, "a"): 2, (1, "b"): 1, (2, "a"): 2, (2, "c"): 2, (2, "d"): 1, (None, "b"): 1, (None, "d"): 2}
    n = {t: sum(x == t for _, x in tf) for t in "abcd"}
    assert got == {k: (c, round(c * math.log(6 / (n[k[1]] + 1)), 6)) for k, c in tf.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    keys = [x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines() if "hashpartitioning(" in x]
    assert any(x.startswith("doc_id#") for x in keys), keys
    assert not any("doc_id#" in x and "term#" in x for x in keys), keys


def test_vectorizers_and_regressions_read_what_they_need(spark, tmp_path):
    from tessera.plans import ml_q
    spark.createDataFrame([(1, "a b a"), (2, "c"), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = ml_q.q_text_vectorizers(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    assert [(r.vocab, r.tfidf_sum > 0) for r in out.orderBy("doc_id").collect()] == [(3, True), (3, True), (3, False)]


def test_top_products_in_cells(spark, monkeypatch):
    import numpy as np

    from tessera.operators import matrix
    for name in ("BLOCK_LEFT", "BLOCK_RIGHT", "TILE_LEFT", "TILE_RIGHT"):
        monkeypatch.setattr(matrix, name, 13 if name.startswith("B") else 4)
    rng = np.random.default_rng(5)
    u, v = rng.integers(-4, 5, (30, 3)), rng.integers(-4, 5, (50, 3)) * rng.integers(1, 9, (50, 1))
    frames = [spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(m)], "id int, features array<float>") for m in (u, v)]
    got = {}
    for r in matrix.top_products(*frames, 5).orderBy("left_id", "rank").collect():
        got.setdefault(r.left_id, []).append((r.right_id, r.score))
    for a in range(30):
        want = sorted(((int(b), float(u[a] @ v[b])) for b in range(50)), key=lambda x: (-x[1], -x[0]))[:5]
        assert got[a] == want


def test_lsh_links_of_split_buckets_equal_the_join(spark, tmp_path, monkeypatch):
    import numpy as np
    from pyspark.ml import feature as FT

    from tessera.operators import lsh
    from tessera.plans import ml_q
    monkeypatch.setattr(lsh, "BLOCK_ROWS", 9)
    monkeypatch.setattr(lsh, "TILE_ROWS", 4)
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(0, 1.6, 3) + 40 * (k % 2)], k % 3) for k in range(60)] + [(60, [500.0] * 3, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component) for r in ml_q.q_lsh_euclidean(spark, str(tmp_path)).collect()}
    e = ml_q.emb_vectors(spark, str(tmp_path))
    model = FT.BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=2.0, numHashTables=3, seed=7).fit(e)
    pairs = [(r.a, r.b) for r in model.approxSimilarityJoin(e, e, 1.5, distCol="dist").where("datasetA.vec_id < datasetB.vec_id")
             .select(F.col("datasetA.vec_id").alias("a"), F.col("datasetB.vec_id").alias("b")).collect()]
    root = {k: k for k in range(61)}
    for _ in range(61):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert pairs and got == {k: (sum(k in p for p in pairs), root[k]) for k in range(61)}


def test_power_iteration_without_graphx(spark, monkeypatch):
    """edges on disk instead of a graph in executor memory; the rounds as numpy's."""
    import numpy as np

    from tessera.operators.graph import power_iteration
    from tessera.plans import community_q, ml_q
    rows = [(a, b, 1.0 + (a * b) % 3) for a in range(6) for b in range(a + 1, 6)] \
        + [(a, b, 2.0) for a in range(10, 15) for b in range(a + 1, 15)] + [(0, 10, 0.01), (3, 3, 9.0)]
    edges = spark.createDataFrame(rows, "i long, j long, weight double")
    ids = sorted({x for r in rows for x in r[:2]})
    at = {x: k for k, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for a, b, x in rows:
        if a != b:
            w[at[a], at[b]] = w[at[b], at[a]] = x
    w /= w.sum(1)[:, None]

    def values(df):
        got = {r.id: r.v for r in df.collect()}
        assert sorted(got) == ids
        return np.array([got[x] for x in ids])
    v = values(power_iteration(edges, max_iterations=0))
    assert abs(np.abs(v).sum() - 1) < 1e-12 and len(set(v)) == len(ids)
    for _ in range(3):
        v = w @ v
        v /= np.abs(v).sum()
    assert np.allclose(values(power_iteration(edges.repartition(5), max_iterations=3)), v, atol=1e-12)
    monkeypatch.setattr(community_q, "graph", lambda s, d: edges)
    monkeypatch.setattr(ml_q.CU, "PowerIterationClustering", None)
    got = {r.id: r.cluster for r in ml_q.q_cluster_power_iteration(spark, "").collect()}
    assert sorted(got) == ids and set(got.values()) <= set(range(4))


def test_similar_pairs_against_brute_force(spark, monkeypatch):
    """pairs of similar sets without comparing all that share one hash."""
    import itertools
    import random

    from tessera.operators import setjoin
    rng = random.Random(3)
    sets = []
    for k in range(60):
        base = set(rng.sample(range(400), rng.choice([1, 2, 5, 17, 40, 60, 120])))
        for part in (0, 1, 2, 3, 10, 20):
            more = [x for x in base if rng.randrange(40) >= part] + rng.sample(range(400), rng.randrange(part + 1))
            sets.append(tuple(sorted(set(more) or base)))
    rows = [(k, list(x), [min(x) % 7, max(x) % 5]) for k, x in enumerate(sets)]
    rows += [(3, list(sets[40]), [min(sets[40]) % 7, max(sets[40]) % 5]), (None, [1], [1, 1]), (900, [], [1, 1])]
    df = spark.createDataFrame(rows, "id long, items array<int>, buckets array<long>")

    def near(x, y, distance=0.3):
        common = len(set(x[1]) & set(y[1]))
        d = 1.0 - common / (len(x[1]) + len(y[1]) - common)
        return d if d < distance and any(a == b for a, b in zip(x[2], y[2])) else None
    ids = [r for r in rows if r[0] is not None and r[1]]
    want = {(min(x[0], y[0]), max(x[0], y[0]), near(x, y)) for x, y in itertools.combinations(ids, 2)
            if x[0] != y[0] and near(x, y) is not None}
    for block in (8192, 3):
        monkeypatch.setattr(setjoin, "BLOCK_ROWS", block)
        got = [tuple(r) for r in setjoin.similar_pairs(df, 400, 0.3).collect()]
        assert len(got) == len(set(got)) and set(got) <= want
        same = {}
        for k, x, _ in ids:
            if k != 3:
                same.setdefault(tuple(x), set()).add(k)
        for x, y, d in set(want) - set(got):      # left out: other copies of the representatives alone
            members = [same.get(tuple(sets[z]), {z}) if z != 3 else {z} for z in (x, y)]
            assert (x, y) != tuple(min(m) for m in members)
            assert d == 0 or any((min(a, b), max(a, b), d) in got for a in map(min, members[:1]) for b in map(min, members[1:]))


def test_lsh_minhash_has_sublinear_candidates(spark, tmp_path, monkeypatch):
    """texts that share their common words alone are no candidates; copies meet one row."""
    from tessera.operators import setjoin
    from tessera.plans import ml_q
    common = " ".join(f"c{k}" for k in range(20))
    texts = [f"{common} " + " ".join(f"w{d}x{k}" for k in range(20)) for d in range(150)]
    rows = [(k, x) for k, x in enumerate(texts)] + [(1000 + k, texts[0]) for k in range(30)] + [(2000, texts[1] + " one more")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    find = setjoin.candidate_pairs
    monkeypatch.setattr(setjoin, "candidate_pairs", lambda *a: seen.append(find(*a).persist()) or seen[0])
    got = {(r.doc_a, r.doc_b): r.jaccard_dist for r in ml_q.q_lsh_minhash(spark, str(tmp_path)).collect()}
    assert got == {(0, 1000 + k): 0.0 for k in range(30)} | {(1, 2000): 1 - 40 / 42}
    assert seen[0].count() < 20


def test_binary_models_after_an_observation(spark, tmp_path, monkeypatch):
    import pytest
    from pyspark.sql import Observation

    from tessera.plans import ml_q
    from tessera.session import own_session
    rows = [(k, f"word{k % 7} " + ("good day" if k % 3 else "bad night"), 10 + k % 5, int(k % 3 > 0), 0) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, quality long, toxic long").coalesce(1)
    df.select("doc_id", "text", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    df.select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    session = own_session(spark)      # the tests' own one stays as it is
    seen = Observation("seen")
    session.read.parquet(f"{tmp_path}/labels.parquet").observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 80
    session.conf.set("spark.sql.shuffle.partitions", "3")
    assert own_session(session).conf.get("spark.sql.shuffle.partitions") == "3"
    assert [r.method for r in ml_q.q_eval_tune_cv(session, str(tmp_path)).collect()] == ["cv", "tvs"]
    # classify_models fits the same kind of model: in a session of its own too
    used = []

    def first_step(other, *args):
        used.append(other)
        raise InterruptedError
    monkeypatch.setattr(ml_q, "_labeled_docs", first_step)
    with pytest.raises(InterruptedError):
        ml_q.q_classify_models(session, str(tmp_path))
    assert len(used) == 1 and used[0] is not session
