"""Queries without SQL over the whole tables."""

import duckdb
import pytest

from cadenza.operators import crossval, metrics, stats
from cadenza.plans.queries import QUERIES
from cadenza.sources import views

def test_every_frame_has_a_png(spark, sf_dir):
    own = QUERIES["snk_png"].run(spark, sf_dir).select("k").collect()
    assert sorted(r["k"] for r in own) == sorted(r[0] for r in duckdb.sql(f"SELECT vec_id FROM '{sf_dir}/embeddings.parquet'").fetchall())


def test_significance_has_all_resamples(spark, sf_dir):
    long = metrics.long_metrics(crossval.per_triplet(views.frames(spark, sf_dir)).select("k", "psnr", "bt_rmse_k"), ["k"], ["psnr", "bt_rmse_k"])
    want = {f"{r['metric']}_{c}": r[c] for r in stats.bootstrap(long, "metric", 2000).collect() for c in ("mean", "low", "high")}
    own = {r["metric"]: r["value"] for r in QUERIES["m35_significance"].run(spark, sf_dir).collect()}
    assert {m: own[m] for m in want} == pytest.approx(want, abs=1e-6)
