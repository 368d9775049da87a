"""A bottom-up market model: dimensions by parameters, compound growth, sensitivity of inputs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The dimensions of the model, key and name, and the share of each region.
WORKLOADS = (("eng", "Data engineering / ETL"), ("wh", "SQL analytics & BI"), ("stream", "Streaming / real-time"), ("ai", "AI/ML & GenAI prep"), ("gov", "Governance / catalog"))
DEPLOYMENTS = (("public", "Public cloud"), ("private", "Private cloud / on-prem"), ("hybrid", "Hybrid"))
TIERS = (("large", "Large enterprise (1 000+ emp)"), ("mid", "Mid-market (100–999 emp)"))
REGIONS = (("North America", 0.40), ("Europe", 0.30), ("APAC", 0.22), ("Rest of World", 0.08))
# The base case of the parameters.
BASE = {
    "firms_large": 50000.0, "firms_mid": 250000.0, "adoption_large": 0.60, "adoption_mid": 0.25, "spend_large": 1500000.0, "spend_mid": 150000.0,
    "share_eng": 0.30, "share_wh": 0.35, "share_stream": 0.10, "share_ai": 0.15, "share_gov": 0.10,
    "deploy_public": 0.65, "deploy_private": 0.15, "deploy_hybrid": 0.20,
    "cagr_eng": 0.12, "cagr_wh": 0.10, "cagr_stream": 0.25, "cagr_ai": 0.35, "cagr_gov": 0.20,
    "cagr_deploy_public": 0.22, "cagr_deploy_private": -0.05, "cagr_deploy_hybrid": 0.15,
    "top_down_snowflake": 3500000000.0, "top_down_databricks": 2400000000.0, "top_down_cloud": 15000000000.0,
}
DRIVERS = ("spend_large", "adoption_large", "cagr_ai", "share_wh", "deploy_public")


def assumptions(spark: SparkSession, values: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(list((values or BASE).items()), "key string, value double")


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _grown(size: pa.Array, growth: pa.Array) -> pa.Array:
    """A size and its compound growth over five years, in cents. Halves are rounded by the exact binary value, which SQL's round doesn't see."""
    rows = zip(size.to_pylist(), growth.to_pylist(), strict=True)
    return pa.array([None if s is None or g is None else [round(s * (1 + g) ** n, 2) for n in range(6)] for s, g in rows], pa.list_(pa.float64()))


def scenario(assumptions: DataFrame, which: str = "base") -> DataFrame:
    """``assumptions(key, value[, low, base, high])`` -> ``(key, value)`` of one case; a blank bound keeps the value."""
    if which not in ("low", "base", "high"):
        raise ValueError("a scenario is low, base or high")
    return assumptions.select("key", F.coalesce(which, "value").alias("value"))


def segments(params: DataFrame) -> DataFrame:
    """``params([scenario,] key, value)`` -> sizes of 2025 to 2030 of each workload, deployment, tier and region.

    With a ``scenario`` column all scenarios are computed in one pass. Growth starts from the
    unrounded size; cells are rounded to cents. A parameter that is missing gives null.
    """
    by = ["scenario"] if "scenario" in params.columns else []
    spark = params.sparkSession
    frame = lambda rows, schema: F.broadcast(spark.createDataFrame(list(rows), schema))  # noqa: E731  # fixed dimensions

    s = frame(WORKLOADS, "w string, workload string").crossJoin(frame(DEPLOYMENTS, "d string, deployment string")).crossJoin(frame(TIERS, "t string, tier string"))
    s = s.crossJoin(frame(REGIONS, "region string, r_share double"))
    # The few parameters of a scenario are one map.
    s = params.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("p")).crossJoin(s)
    value = lambda prefix, key: F.element_at("p", F.concat(F.lit(prefix), key))
    growth = (value("cagr_", "w") + value("cagr_deploy_", "d")) / 2
    size = value("firms_", "t") * value("adoption_", "t") * value("spend_", "t") * value("share_", "w") * value("deploy_", "d") * F.col("r_share")
    s = s.select(*by, "workload", "deployment", "tier", "region", growth.alias("growth"), _grown(size, growth).alias("y"))
    return s.select(*by, "workload", "deployment", "tier", "region", *[F.col("y")[n].alias(f"size_{2025 + n}") for n in range(6)], F.round("growth", 4).alias("cagr"))


def totals(seg: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the first and the last year, and the growth rate between them."""
    t = seg.groupBy(*by).agg(F.round(F.sum("size_2025"), 2).alias("size_2025"), F.round(F.sum("size_2030"), 2).alias("size_2030"))
    return t.withColumn("cagr", F.round(F.pow(F.col("size_2030") / F.col("size_2025"), F.lit(0.2)) - 1, 4))


def top_down(params: DataFrame, seg: DataFrame) -> DataFrame:
    """The sum of public references and its gap to the bottom-up total."""
    ref = params.where(F.col("key").startswith("top_down_")).agg(F.sum("value").alias("top_down"), F.count("*").alias("n_references"))
    return ref.crossJoin(seg.agg(F.round(F.sum("size_2025"), 2).alias("bottom_up"))).withColumn("gap", F.round(F.col("bottom_up") - F.col("top_down"), 2))


def sensitivity(params: DataFrame, drivers: tuple[str, ...] = DRIVERS, factor: float = 0.2) -> DataFrame:
    """``(input, direction, delta)`` of the last year's total when one input is changed by the factor, both ways."""
    spark = params.sparkSession
    cases = [("base", None, 1.0), *[(f"{d}:{n}", d, 1 + sign * factor) for d in drivers for n, sign in (("low", -1), ("high", 1))]]
    c = F.broadcast(spark.createDataFrame(cases, "scenario string, driver string, by double"))
    p = params.crossJoin(c).withColumn("value", F.col("value") * F.when(F.col("key") == F.col("driver"), F.col("by")).otherwise(1.0)).select("scenario", "key", "value")
    t = segments(p).groupBy("scenario").agg(F.sum("size_2030").alias("total"))
    base = t.where("scenario = 'base'").select(F.col("total").alias("base"))
    d = t.where("scenario <> 'base'").crossJoin(F.broadcast(base))
    part = F.split("scenario", ":")
    return d.select(part[0].alias("input"), part[1].alias("direction"), F.round(F.col("total") - F.col("base"), 2).alias("delta"))


def fastest(seg: DataFrame, n: int = 5) -> DataFrame:
    return seg.select("workload", "deployment", "cagr").distinct().orderBy(F.desc("cagr"), "workload", "deployment").limit(n)


def recomputed(seg: DataFrame) -> DataFrame:
    """What a workbook would compute for the last year from its cells, and the gap to the model's."""
    again = F.round(F.col("size_2025") * F.pow(1 + F.col("cagr"), F.lit(5.0)), 2)
    return seg.withColumn("size_2030_again", again).withColumn("gap", F.round(again - F.col("size_2030"), 2))


def ranked(seg: DataFrame) -> DataFrame:
    """Segments by size in the last year."""
    return seg.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size_2030"), "workload", "deployment", "tier", "region")))
