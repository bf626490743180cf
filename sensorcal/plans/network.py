"""Score a whole network and report its anomalies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import network as net
from ..operators.clean import drop_all_null
from ..operators.halo import neighbour_deviations
from ..operators.timeseries import resample_mean
from ..runtime import materialize
from ..schema import ScoreParams


@dataclass(frozen=True)
class NetworkResult:
    scores: DataFrame
    deviation: DataFrame
    anomalous: DataFrame
    windows: DataFrame
    report: DataFrame


def score_network(
    readings: DataFrame,
    sites: DataFrame,
    time: str,
    channels: Sequence[str],
    weather: Sequence[str],
    step_us: int,
    params: ScoreParams = ScoreParams(),
) -> NetworkResult:
    """Resample, score all channels from one exchange of the grid, detect and localize.

    The grid, the neighbour edges, the deviations and the scores are each written once. ``report`` has one row
    per channel: the parameters, the threshold with its kind, number of anomalous sites by threshold and by two
    clusters, the worst site and the anomaly windows there (a list no longer than the time grid).
    """
    measures = list(dict.fromkeys((*channels, *weather)))
    present = drop_all_null(readings, [net.SITE, time], measures)
    grid = materialize(resample_mean(present, time, step_us, measures, [net.SITE]), "grid")
    edges = materialize(net.knn_sites(sites, params.k_neighbors), "edges")
    dev = neighbour_deviations(grid, sites, edges, channels, weather, params.k_meteo, params.eps, block_us=256 * step_us)
    dev = materialize(dev, "deviation")
    tci = net.jump_rate_tci(dev, jump_z=params.jump_z)
    scores = materialize(net.reliability_index(net.sci(dev), tci, net.mean_per_site(dev, "e_meteo", "mci"), params), "scores")
    anomalous = net.anomaly_sites(scores, params)
    windows = materialize(net.anomaly_windows(dev, params), "windows")
    worst = net.worst_site(scores)
    on_worst = (
        windows.join(worst, (windows.channel == worst.channel) & (windows[net.SITE] == worst.worst_site))
        .groupBy(windows.channel)
        .agg(F.array_sort(F.collect_list(F.struct("start_index", "end_index", "start_dt", "end_dt", "len"))).alias("windows"))
    )
    counts = anomalous.groupBy("channel").agg(F.count("*").alias("n_anomalous"))
    clusters = net.kmeans_anomaly(scores).groupBy("channel").agg(
        F.count("*").alias("n_sites"),
        F.struct(
            F.count_if("anomalous").alias("n_anomalous"),
            F.min(F.when(F.col("anomalous"), F.col("cluster_mean_ri"))).alias("anomalous_mean_ri"),
            F.min(F.when(~F.col("anomalous"), F.col("cluster_mean_ri"))).alias("other_mean_ri"),
        ).alias("two_means"),
    )
    by_quantile = params.ri_quantile is not None
    threshold = F.struct(
        F.lit("quantile" if by_quantile else "fixed").alias("type"),
        F.col("threshold").alias("value"),
        F.lit(params.ri_quantile).cast("double").alias("quantile_q"),
        F.lit(params.ri_fixed).alias("fixed_value"),
    )
    report = (
        worst.join(net.ri_threshold(scores, params), "channel", "left")
        .join(counts, "channel", "left")
        .join(on_worst, "channel", "left")
        .join(clusters, "channel", "left")
        .select(
            "channel",
            F.lit(params.k_neighbors).alias("k_neighbors"),
            F.lit(params.k_meteo).alias("k_meteo"),
            F.struct(
                F.lit(params.alpha).alias("alpha"), F.lit(params.beta).alias("beta"), F.lit(params.gamma).alias("gamma")
            ).alias("weights"),
            "n_sites",
            F.lit(step_us).alias("step_us"),
            threshold.alias("threshold"),
            F.lit(params.jump_z).alias("jump_z"),
            "two_means",
            F.coalesce("n_anomalous", F.lit(0)).alias("n_anomalous"),
            "worst_site",
            F.coalesce(F.size("windows"), F.lit(0)).alias("n_windows"),
            "windows",
        )
    )
    return NetworkResult(scores, dev, anomalous, windows, report)
