"""Order statistics, ranks, matrices, evaluators and as-of directions against
numpy, pandas or brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from tessera.operators import joins as J
from tessera.operators import matrix as M
from tessera.operators import ranks as R
from tessera.operators import timeseries as TS
from tessera.operators.evaluate import ranking_metrics


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value most of that group; nulls, ties, a group of nulls."""
    rng = np.random.default_rng(3)
    rows = [("hot", 5.0)] * 2000 + [("hot", float(x)) for x in rng.integers(0, 400, 3000)]
    rows += [(None, float(x)) for x in rng.normal(size=50)] + [("one", 7.0), ("none", None), ("one", None)]
    return spark.createDataFrame(rows, "g string, v double"), pd.DataFrame(rows, columns=["g", "v"])


def test_exact_percentiles(skewed):
    df, pdf = skewed
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    got = {r.g: r for r in R.exact_percentiles(df, ["g"], "v", points).collect()}
    for g in ("hot", "one", None):
        v = pdf[pdf.g.isna() if g is None else pdf.g == g].v.dropna()
        for name, p in points.items():
            assert got[g][name] == pytest.approx(np.quantile(v, p), rel=1e-12)
    assert set(got) == {"hot", "one", "none", None} and got["none"].p50 is None
    total = R.exact_percentiles(df, [], "v", {"m": 0.5}).collect()
    assert len(total) == 1 and total[0].m == pytest.approx(pdf.v.median())
    assert R.exact_percentiles(df.where("false"), ["g"], "v", points).count() == 0


def test_a_hot_group_is_spread(skewed):
    from tessera.operators.iterate import write_table
    df, _ = skewed
    counts = df.groupBy("g", "v").agg(F.count("v").alias("n"))
    parts = write_table(counts.repartitionByRange(8, "g", "v").withColumn("p", F.spark_partition_id()), "t")
    assert parts.where("g = 'hot'").select("p").distinct().count() > 3


def test_average_ranks_and_spearman(spark, skewed):
    df, pdf = skewed
    got = sorted((r.v, r["rank"]) for r in R.average_ranks(df, "v").where("v IS NOT NULL").collect())
    want = sorted(zip(pdf.v.dropna(), pdf.v.dropna().rank()))
    assert got == want and R.average_ranks(df, "v").where("v IS NULL AND rank IS NULL").count() == 2
    rng = np.random.default_rng(4)
    a = rng.integers(0, 20, 3000).astype(float)
    p = pd.DataFrame({"a": a, "b": a + rng.normal(scale=9, size=3000).round(), "c": 1.0})
    p.loc[::50, "b"] = np.nan
    s = spark.createDataFrame(p).withColumn("b", F.nanvl("b", F.lit(None)))
    out = {(r.a, r.b): r.r for r in R.spearman(s, [("a", "b"), ("a", "c")]).collect()}
    known = p.dropna()
    want = np.corrcoef(known.a.rank(), known.b.rank())[0, 1]
    assert out[("a", "b")] == pytest.approx(want, abs=1e-12) and out[("a", "c")] is None


def test_svd_and_column_similarities(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 7)) @ np.diag([9, 5, 3, 1, 0.5, 0.1, 0.0])
    rows = [(k, [float(e) for e in r]) for k, r in enumerate(x)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(5)
    s, v, u = M.svd(df, "id", "vec")
    want = np.linalg.svd(x, compute_uv=False)
    assert len(s) == 6 and np.allclose(s, want[:6], rtol=1e-9)
    back = np.array([r.u for r in u.orderBy("id").collect()])
    assert np.allclose(back * s @ v.T, x, atol=1e-8)
    assert len(M.svd(df, "id", "vec", 2)[0]) == 2
    sims = {(r.i, r.j): r.sim for r in M.column_similarities(df, "vec").collect()}
    norm = np.linalg.norm(x, axis=0)
    assert sims[(0, 1)] == pytest.approx(x[:, 0] @ x[:, 1] / norm[0] / norm[1]) and sims[(0, 6)] is None
    assert len(sims) == 21 and len(M.svd(df.where("false"), "id", "vec")[0]) == 0


def test_ranking_metrics(spark):
    truth = {1: [10, 20, 30], 2: [40], 3: [50, 60]}
    offer = {1: [10, 99, 30, 20], 2: [98, 97], 4: [10]}
    rel = spark.createDataFrame([(q, i) for q, xs in truth.items() for i in xs * 2], "q long, i long")
    pred = spark.createDataFrame([(q, i, n + 1) for q, xs in offer.items() for n, i in enumerate(xs)],
                                 "q long, i long, r int")
    got = ranking_metrics(pred, rel, "q", "i", "r", 3).first()
    ideal = 1 + 1 / np.log2(3) + 1 / np.log2(4)
    assert got.queries == 3 and got.precision_at_k == pytest.approx(2 / 3 / 3)
    assert got.recall_at_k == pytest.approx(2 / 3 / 3) and got.map_at_k == pytest.approx((1 + 2 / 3) / 3 / 3)
    assert got.ndcg_at_k == pytest.approx((1 + 1 / np.log2(4)) / ideal / 3)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_directions(spark, direction):
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    p = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = ev.where("event_type = 'view'").select("event_id", "user_id", "ts")
    tol = 9 * 3600
    got = {r.event_id: r.r_event_id for r in
           J.asof_join(p, v, "user_id", "ts", "ts", tol, ["event_id"], direction=direction).collect()}
    right = v.toPandas().rename(columns={"event_id": "r"}).sort_values("ts")
    want = pd.merge_asof(p.toPandas().sort_values("ts"), right, on="ts", by="user_id", direction=direction,
                         tolerance=pd.Timedelta(seconds=tol))
    assert got == {e: None if pd.isna(r) else int(r) for e, r in zip(want.event_id, want.r)}
    assert sum(x is not None for x in got.values()) > 0


def test_frame_shape(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=60)
    df = spark.createDataFrame([(1, k, float(e)) for k, e in enumerate(x)], "g int, k int, v double")
    got = TS.frame_shape(df, ["g"], ["k"], "v", 9, 5, {"q": 0.3}).orderBy("k").toPandas()
    roll = pd.Series(x).rolling(9, min_periods=5)
    for name, want in (("min", roll.min()), ("var", roll.var()), ("skew", roll.skew()), ("kurt", roll.kurt()),
                       ("q", roll.quantile(0.3))):
        assert np.allclose(got["roll_" + name].astype(float), want, equal_nan=True, atol=1e-9), name
    grown = TS.frame_shape(df, ["g"], ["k"], "v", None).orderBy("k").toPandas()
    assert np.allclose(grown.roll_kurt.astype(float), pd.Series(x).expanding(4).kurt(), equal_nan=True, atol=1e-9)
    with pytest.raises(ValueError):
        TS.frame_shape(df, ["g"], ["k"], "v", None, quantiles={"q": 0.5})
