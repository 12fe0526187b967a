"""Forecasting runs: they learn, so no SQL stands beside them; tests hold their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from volatide.operators import residual
from volatide.plans import flows
from volatide.plans.news_queries import DailyParts, build_frame
from volatide.plans.registry import Registry

REGISTRY = query = Registry()


@query()
def residual_forecast(spark, sf_dir):
    frame = build_frame(spark, sf_dir)
    ends = _ends(frame)
    return residual.hybrid_forecasts(frame, *ends)


@query()
def garchx_forecast(spark, sf_dir):
    frame = build_frame(spark, sf_dir)
    return residual.garchx_forecasts(frame, _ends(frame)[1])


@query()
def robustness_specs(spark, sf_dir):
    parts = DailyParts(spark, sf_dir)
    frame_of = lambda threshold=0.05, target="parkinson": build_frame(spark, sf_dir, threshold, target, parts)
    return flows.robustness(frame_of, residual.specifications(), *_ends(frame_of()))


@query()
def experiment_errors(spark, sf_dir):
    frame = build_frame(spark, sf_dir)
    return flows.experiment(frame, *_ends(frame))["errors"]


def _ends(frame) -> tuple[str, str]:
    """Dates at 70 and 85 percent of the sessions (two values)."""
    row = frame.agg(F.percentile_approx("date", F.array(F.lit(0.7), F.lit(0.85)), F.lit(10_000)).alias("p")).first()["p"]
    return str(row[0]), str(row[1])
