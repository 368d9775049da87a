"""Feature matrices: capabilities by vendor, group scores, positions on two axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The capabilities of the two axes.
OPENNESS = ("iceberg_read_write", "delta_support", "rest_catalog_interop", "cross_system_lineage")
DEPLOYMENT = ("self_managed_onprem", "private_cloud", "multi_cloud", "sovereign_airgapped", "single_control_plane")


def feature_matrix(features: DataFrame, vendors: list[str]) -> DataFrame:
    """``features(vendor, capability, score)`` -> a row for each capability, a column for each vendor."""
    return features.groupBy("capability").pivot("vendor", vendors).agg(F.avg("score"))


def group_scores(features: DataFrame, vendors: list[str], places: int = 2) -> DataFrame:
    means = features.groupBy("group").pivot("vendor", vendors).agg(F.avg("score"))
    return means.select("group", *[F.round(F.col(f"`{v}`"), places).alias(v) for v in vendors])


def positions(features: DataFrame, x: tuple[str, ...] = DEPLOYMENT, y: tuple[str, ...] = OPENNESS, places: int = 2) -> DataFrame:
    """The mean scores of each vendor over two lists of capabilities."""
    mean = lambda caps: F.round(F.avg(F.when(F.col("capability").isin(*caps), F.col("score"))), places)
    return features.groupBy("vendor").agg(mean(x).alias("deploy_flex"), mean(y).alias("openness"))


def position_order(positions: DataFrame) -> DataFrame:
    """Positions with ``place``: vendors by the sum of both axes, descending, missing ones last, ties by name. One row a vendor."""
    both = F.desc_nulls_last(F.col("deploy_flex") + F.col("openness"))
    return positions.withColumn("place", F.row_number().over(Window.orderBy(both, "vendor")))
