"""Custom operators against brute force on small fixtures from the tables."""

import heapq
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF0001
from tessera.operators import aggregates as A
from tessera.operators import basket as B
from tessera.operators import graph as G
from tessera.operators import joins as J
from tessera.operators import timeseries as TS


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF0001}/events.parquet")


def _us(ts):
    return int(pd.Timestamp(ts).value // 1000)


def test_asof_join_matches_brute_force(events):
    p = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    tol = 6 * 3600
    got = {r.event_id: r.r_event_id for r in J.asof_join(p, v, "user_id", "ts", "ts", tol, ["event_id"]).collect()}
    views = defaultdict(list)
    for r in v.collect():
        views[r.user_id].append((_us(r.ts), r.event_id))
    want = {}
    for r in p.collect():
        t = _us(r.ts)
        cands = [(tv, eid) for tv, eid in views[r.user_id] if tv <= t and t - tv <= tol * 1_000_000]
        want[r.event_id] = max(cands)[1] if cands else None
    assert got == want


def test_interval_join_matches_brute_force(events):
    p = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    c = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    gap = 6 * 3600
    got = sorted((r.event_id_l, r.event_id_r) for r in J.interval_join(p, c, "user_id", "ts", "ts", gap).collect())
    pc = [(r.event_id, r.user_id, _us(r.ts)) for r in p.collect()]
    cc = [(r.event_id, r.user_id, _us(r.ts)) for r in c.collect()]
    want = sorted((a, b) for a, ua, ta in pc for b, ub, tb in cc if ua == ub and 0 <= tb - ta <= gap * 1_000_000)
    assert got == want and len(want) > 0


def test_range_join_matches_brute_force(spark):
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    part = spark.read.parquet(f"{SF0001}/part.parquet").select(
        "p_partkey", (F.col("p_retailprice") - 5).alias("lo"), (F.col("p_retailprice") + 5).alias("hi"))
    got = {r.p_partkey: r.n for r in J.range_join(li, "u", part, "lo", "hi", 3.0)
           .groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n")).collect()}
    us = [r.u for r in li.collect()]
    want = {}
    for r in part.collect():
        n = sum(1 for u in us if r.lo <= u <= r.hi)
        if n:
            want[r.p_partkey] = n
    assert got == want


def test_row_index_is_consecutive(spark):
    o = spark.read.parquet(f"{SF0001}/orders.parquet").select("o_orderkey")
    rows = J.row_index(o, "o_orderkey", num_partitions=4).collect()
    pairs = sorted((r.o_orderkey, r.idx) for r in rows)
    assert [i for _, i in pairs] == list(range(len(pairs)))


def test_salted_agg_equals_plain(spark):
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    aggs = {"n": ("count", None), "q": ("sum", "l_quantity"), "lo": ("min", "l_discount"), "hi": ("max", "l_tax")}
    got = {r.l_returnflag: (r.n, round(r.q, 6), r.lo, r.hi) for r in A.salted_agg(li, ["l_returnflag"], aggs, 7).collect()}
    want = {r.l_returnflag: (r.n, round(r.q, 6), r.lo, r.hi) for r in li.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.min("l_discount").alias("lo"),
        F.max("l_tax").alias("hi")).collect()}
    assert got == want


def test_salted_pairs_equal_bounded_pairs(spark):
    o, op = B.from_tpch(spark.read.parquet(f"{SF0001}/orders.parquet"), spark.read.parquet(f"{SF0001}/lineitem.parquet"))
    items = B.basket_items(op, B.order_windows(o, 7))
    a = B.basket_pairs(items)
    b = B.basket_pairs(items, hot_basket_items=2)  # almost every basket takes the salted path
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _chain_edges(spark):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = spark.read.parquet(f"{SF0001}/orders.parquet")
    return o.withColumn("prev", F.lag("o_orderkey").over(w)).where("prev IS NOT NULL") \
        .select(F.col("prev").alias("src"), F.col("o_orderkey").alias("dst"))


def test_components_match_union_find(spark):
    e = _chain_edges(spark)
    got = {r.node: r.component for r in G.connected_components(e).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for r in e.collect():
        a, b = find(r.src), find(r.dst)
        if a != b:
            parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for n in list(parent):
        groups[find(n)].append(n)
    want = {n: min(ms) for ms in groups.values() for n in ms}
    assert got == want


def _item_edges(spark):
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct()
    return li.alias("a").join(li.alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey"))
                              & (F.col("a.l_partkey") < F.col("b.l_partkey"))) \
        .groupBy(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")) \
        .agg(F.count(F.lit(1)).alias("n"))


def test_triangles_match_brute_force(spark):
    e = _item_edges(spark)
    got = {r.node: r.triangles for r in G.triangles(e).collect()}
    adj = defaultdict(set)
    for r in e.collect():
        adj[r.src].add(r.dst)
        adj[r.dst].add(r.src)
    want = defaultdict(int)
    for a in adj:
        for b in adj[a]:
            if b > a:
                for c in adj[a] & adj[b]:
                    if c > b:
                        for x in (a, b, c):
                            want[x] += 1
    assert got == dict(want) and len(want) > 0


def test_shortest_paths_match_dijkstra(spark):
    e = _item_edges(spark).select("src", "dst", (1.0 / F.col("n")).alias("w"))
    rows = e.collect()
    source = min(r.src for r in rows)
    got = {r.node: round(r.dist, 9) for r in G.shortest_paths(e, source).collect()}
    adj = defaultdict(list)
    for r in rows:
        adj[r.src].append((r.dst, r.w))
        adj[r.dst].append((r.src, r.w))
    dist = {source: 0.0}
    heap = [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist.get(u, float("inf")):
            continue
        for v, w in adj[u]:
            if d + w < dist.get(v, float("inf")):
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    assert got == {k: round(v, 9) for k, v in dist.items()}


def test_transitive_closure_matches_bfs(spark):
    e = _chain_edges(spark).limit(0).union(
        spark.read.parquet(f"{SF0001}/nation.parquet").select(
            F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") + 5) % 25).cast("long").alias("dst")))
    got = {(r.src, r.dst) for r in G.transitive_closure(e).collect()}
    adj = defaultdict(set)
    for r in e.collect():
        adj[r.src].add(r.dst)
    want = set()
    for s in list(adj):
        seen, stack = set(), [s]
        while stack:
            u = stack.pop()
            for v in adj[u]:
                if v not in seen:
                    seen.add(v)
                    stack.append(v)
        want |= {(s, v) for v in seen}
    assert got == want


def test_ewm_matches_pandas(events):
    out = TS.ewm_mean(events, ["user_id"], ["ts", "event_id"], "value", 0.3).select("event_id", "user_id", "ts", "value", "ewm")
    pdf = out.toPandas().sort_values(["user_id", "ts", "event_id"])
    want = pdf.groupby("user_id")["value"].transform(lambda s: s.ewm(alpha=0.3, adjust=True).mean())
    assert (abs(pdf["ewm"] - want) < 1e-9).all()


def test_fill_and_interpolate_match_pandas(events):
    ev = events.withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    out = TS.fill_and_interpolate(ev, ["user_id"], ["ts", "event_id"], "v").toPandas() \
        .sort_values(["user_id", "ts", "event_id"]).reset_index(drop=True)
    g = out.groupby("user_id")["v"]
    pd.testing.assert_series_equal(out["ffill"], g.ffill(), check_names=False)
    pd.testing.assert_series_equal(out["bfill"], g.bfill(), check_names=False)
    interp = g.transform(lambda s: s.reset_index(drop=True).interpolate(limit_area="inside").set_axis(s.index))
    assert ((out["interp"] - interp).abs().fillna(0) < 1e-9).all()
    assert (out["interp"].isna() == interp.isna()).all()


def test_loops_reach_their_fixed_point(spark):
    """Chains longer than any round limit: every node is reached, and a limit
    that is too low raises."""
    from tessera.operators import graph as G
    n = 130
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "src long, dst long, w double").coalesce(2)
    got = {r.node: r.dist for r in G.shortest_paths(e, 0).collect()}
    assert got == {i: float(i) for i in range(n + 1)}
    assert {r.component for r in G.connected_components(e).collect()} == {0}
    assert G.transitive_closure(e.limit(40)).count() == 40 * 41 // 2
    with pytest.raises(RuntimeError):
        G.shortest_paths(e, 0, max_rounds=3)
    with pytest.raises(RuntimeError):
        G.transitive_closure(e, max_rounds=2)


def test_ewm_keeps_old_values(spark):
    import math

    from tessera.operators import timeseries as TS
    x = [1e200] + [1.0] * 500 + [None, 2.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)] + [(None, 0, 3.0)], "k int, t int, v double")
    got = {(r.k, r.t): r.ewm for r in TS.ewm_mean(df, ["k"], ["t"], "v", 0.5).collect()}
    num = den = 0.0
    for i, v in enumerate(x):
        if v is not None:
            num, den = num * 0.5 + v, den * 0.5 + 1
        assert math.isclose(got[1, i], num / den, rel_tol=1e-9)
    assert got[None, 0] == 3.0


def _table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_item_sets_of_any_size(spark, tmp_path):
    from tessera.plans.ml_q import q_fp_itemsets
    sf = _table(spark, tmp_path, "lineitem", [(o, p) for o in range(3) for p in (1, 2, 3, 4)], "l_orderkey long, l_partkey long")
    got = [(tuple(r["items"]), r.freq) for r in q_fp_itemsets(spark, sf).collect()]
    assert len(got) == 15 and ((1, 2, 3, 4), 3) in got and ((1, 3, 4), 3) in got


def test_sequences_of_any_length(spark, tmp_path):
    from tessera.plans.ml_q import q_fp_sequences
    import datetime as dt
    day = dt.datetime(2024, 1, 1)
    rows = [(u, day + dt.timedelta(hours=i), u * 9 + i, t) for u in range(2) for i, t in enumerate("abcde")]
    rows.append((0, day + dt.timedelta(hours=13), 99, "f"))         # 9 hours later: a session of its own
    sf = _table(spark, tmp_path, "events", rows, "user_id long, ts timestamp_ntz, event_id long, event_type string")
    got = {"".join(x[0] for x in r.sequence): r.freq for r in q_fp_sequences(spark, sf).collect()}
    assert len(got) == 32 and got["abcde"] == 2 and got["f"] == 1


def test_vectorizers_keep_all_terms(spark, tmp_path):
    from tessera.plans.ml_q import q_text_vectorizers
    sf = _table(spark, tmp_path, "documents", [(i, " ".join(f"w{i}_{k}" for k in range(2500)), "en") for i in range(2)],
                "doc_id long, text string, lang string")
    assert [r.vocab for r in q_text_vectorizers(spark, sf).collect()] == [5000, 5000]


def test_lda_sees_all_terms(spark, tmp_path, monkeypatch):
    from tessera.plans import ml_q
    _table(spark, tmp_path, "embeddings", [(i, 0, [float(i), i % 3.0]) for i in range(12)], "vec_id long, label int, embedding array<double>")
    sf = _table(spark, tmp_path, "documents", [(i, " ".join(f"w{i}_{k}" for k in range(300)), "en") for i in range(4)],
                "doc_id long, text string, lang string")
    fitted = []
    fit = ml_q.CU.LDA.fit
    monkeypatch.setattr(ml_q.CU.LDA, "fit", lambda self, df: fitted.append(df) or fit(self, df))
    ml_q.q_cluster_models(spark, sf).collect()
    terms = fitted[0].select(F.udf(lambda v: float(v.values.sum()), "double")("features").alias("n")).collect()
    assert [r.n for r in terms] == [300.0] * 4


def test_pivots_keep_new_values(spark, tmp_path):
    from tessera.plans.aggregate_q import q_agg_pivot
    from tessera.plans.window_q import q_table_pivot_dummies
    _table(spark, tmp_path, "customer", [(1, "BUILDING"), (2, "SPACE"), (3, None)], "c_custkey long, c_mktsegment string")
    sf = _table(spark, tmp_path, "orders", [(1, "1-URGENT", "F", 2.0), (1, "1-URGENT", "X", 3.0), (2, "1-URGENT", None, 4.0)],
                "o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double")
    assert q_agg_pivot(spark, sf).first().asDict() == {"o_orderpriority": "1-URGENT", "F": 1, "O": 0, "P": 0, "X": 1, "null": 1}
    rows = {r.c_custkey: r.asDict() for r in q_table_pivot_dummies(spark, sf).collect()}
    assert rows[2]["seg_SPACE"] == 1 and rows[1]["seg_SPACE"] == 0 and rows[1]["X"] == 3.0 and rows[2]["null"] == 4.0
