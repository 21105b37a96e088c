"""Bootstraps of whole clusters, and bounds of Beta posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelweave.functions.hashing import unit_draw


def cluster_draws(clusters: DataFrame, stratum: str, cluster: str, draws: int, seed: str) -> DataFrame:
    """Rows of clusters, one for each time that a draw has them: as many clusters of each stratum as it has, with replacement.

    clusters: a row of sums for each cluster, so that a draw moves no items. The draws are hashes of seed, draw, stratum and place.
    """
    w = Window.partitionBy(stratum)
    numbered = clusters.withColumns({"i": F.row_number().over(w.orderBy(cluster)).cast("long"), "of": F.count(F.lit(1)).over(w)})
    chance = unit_draw(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col(stratum), F.col("i").cast("string")))
    picks = numbered.select(stratum, "i", "of", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picks = picks.select("draw", stratum, (1 + F.floor(chance * F.col("of"))).cast("long").alias("i"))
    return picks.join(numbered.drop("of"), [stratum, "i"])


def beta_bounds(alpha: Column, beta: Column, n: Column, least: int, z: float) -> tuple[Column, Column]:
    """Mean of a Beta distribution, and the mean less z deviations, within [0, 1], from `least` observations on."""
    whole = alpha + beta
    mean = alpha / whole
    low = mean - z * F.sqrt(alpha * beta / (whole * whole * (whole + 1)))
    return F.round(mean, 6).alias("mean"), F.round(F.when(n < least, mean).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), low))), 6).alias("lower")
