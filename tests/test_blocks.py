"""Frames in blocks with carries against pandas, with one group of most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import timeseries as TS

SIZE = 16


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out, n = [], 0
    for g, count in (("hot", 700), (None, 40), ("one", 1), ("edge", 2 * SIZE), ("gap", 3 * SIZE)):
        for k in range(count):
            known = g != "gap" or k in (1, 3 * SIZE - 2)
            out.append((g, n, float(rng.integers(0, 100)) if known and rng.random() > 0.2 else None))
            n += 1
    df = spark.createDataFrame(out, "g string, t long, v double").repartition(5)
    return df, pd.DataFrame(out, columns=["g", "t", "v"]).fillna({"g": "null"})


def same(got, want):
    got, want = np.asarray(got, float), np.asarray(want, float)
    assert np.allclose(got, want, equal_nan=True)


def test_places_and_blocks(rows):
    df, pdf = rows
    got = B.placed(df, ["g"], ["t"], SIZE).orderBy("t").toPandas()
    place = pdf.groupby("g").cumcount()
    assert got["_pos"].tolist() == place.tolist() and got["_blk"].tolist() == (place // SIZE).tolist()
    assert B.placed(df.where("false"), ["g"], ["t"], SIZE).count() == 0


def test_running_frames(rows):
    df, pdf = rows
    v = F.col("v")
    out = B.running(B.placed(df, ["g"], ["t"], SIZE), ["g"], {k: (k, v) for k in B.RUNNING}).orderBy("t").toPandas()
    by = pdf.groupby("g")["v"]
    known = pdf.v.notna().groupby(pdf.g).cumsum()
    same(out["last"], by.ffill())
    same(out["next"], by.bfill())
    same(out["count"], known)
    same(out["sum"], pdf.v.fillna(0).groupby(pdf.g).cumsum().where(known > 0))
    same(out["min"], by.cummin().groupby(pdf.g).ffill())
    same(out["max"], by.cummax().groupby(pdf.g).ffill())


@pytest.mark.parametrize("back", [0, 2, SIZE - 1])
def test_moving_frames_cross_blocks(rows, back):
    df, pdf = rows
    placed = B.placed(df, ["g"], ["t"], SIZE)
    out = B.moving(placed, ["g"], back, {"mean": F.avg("v").over, "n": F.count("v").over}, SIZE).orderBy("t").toPandas()
    frame = pdf.groupby("g")["v"].rolling(back + 1, min_periods=1)
    same(out["mean"], frame.mean().reset_index(level=0, drop=True).sort_index())
    same(out["n"], pdf.v.notna().astype(int).groupby(pdf.g).rolling(back + 1, min_periods=1).sum()
         .reset_index(level=0, drop=True).sort_index())
    with pytest.raises(ValueError):
        B.moving(placed, ["g"], SIZE, {}, SIZE)


def test_fills_over_blocks(rows):
    df, pdf = rows
    out = TS.fill_and_interpolate(df, ["g"], ["t"], "v", SIZE).orderBy("t").toPandas()
    want = pdf.groupby("g")["v"].transform(lambda s: s.interpolate(limit_area="inside"))
    same(out["interp"], want)
    assert out.columns.tolist() == ["g", "t", "v", "ffill", "bfill", "interp"]


def test_totals_and_a_spread_group(rows):
    df, pdf = rows
    out = B.with_totals(df, ["g"], {"s": F.sum("v"), "n": F.count(F.lit(1))}).orderBy("t").toPandas()
    same(out["s"], pdf.groupby("g")["v"].transform("sum").where(pdf.groupby("g")["v"].transform("count") > 0))
    same(out["n"], pdf.groupby("g")["t"].transform("count"))
    hot = B.placed(df, ["g"], ["t"], SIZE).where("g = 'hot'").groupBy("_blk").count().toPandas()
    assert len(hot) == -(-700 // SIZE) and hot["count"].max() == SIZE
