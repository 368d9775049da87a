"""A simulated CRM: seeded tables, and the queries over such tables.

Every random number is a hash of the seed, the key and a name, so rows don't depend on partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.operators.ordering import numbered, tile
from weftwork.operators.quantiles import with_quantiles

# The parameters of the simulation.
PARAMS = {
    "seed": 42, "accounts": 1500, "opportunities": 4000, "win_rate": 0.35, "churn_rate": 0.08, "expansion_rate": 0.30, "contraction_rate": 0.12,
    "quarters": 8, "sprints_per_quarter": 6, "points": 40, "on_time_rate": 0.72,
    "industries": {x: 1.0 for x in ("Financial Services", "Healthcare", "Technology", "Retail", "Manufacturing", "Energy", "Government", "Media")},
    "regions": {"North America": 0.40, "Europe": 0.30, "APAC": 0.22, "Rest of World": 0.08},
    "tiers": {"Large Enterprise": 0.35, "Mid-Market": 0.65},
    "deployments": {"Public Cloud": 0.60, "Private Cloud": 0.20, "Hybrid": 0.20},
    "arr_bands": {"<50K": 0.30, "50K-200K": 0.30, "200K-500K": 0.20, "500K-1M": 0.12, ">1M": 0.08},
    "competitors": {"Snowflake": 0.25, "Databricks": 0.22, "AWS": 0.18, "Google": 0.12, "Microsoft": 0.10, "Cloudera": 0.05, "Other": 0.08},
    "stages": ("Prospecting", "Qualification", "Technical Evaluation", "Proposal", "Negotiation", "Closed Won", "Closed Lost"),
    "loss_reasons": {"Cost": 0.317, "Operational Complexity": 0.175, "Lock-in Concerns": 0.127, "Performance Issues": 0.127, "Right-sizing / Overkill": 0.111, "Ecosystem Fit": 0.063, "Governance / Security": 0.032, "Other": 0.048},
    "services": ("engineering", "warehouse", "streaming", "ai"),
    "pm_teams": ("Platform", "Analytics", "Security", "Data Integration"),
}


def _u(seed: int, name: str, *keys: str) -> Column:
    """A uniform number in (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _choice(u: Column, weights: dict[str, float]) -> Column:
    total, at, out = sum(weights.values()), 0.0, None
    for name, w in list(weights.items())[:-1]:
        at += w / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    last = list(weights)[-1]
    return F.lit(last) if out is None else out.otherwise(last)


def _normal(seed: int, name: str, *keys: str) -> Column:
    return F.sqrt(-2 * F.log(_u(seed, name + "/a", *keys))) * F.cos(2 * math.pi * _u(seed, name + "/b", *keys))


def generate(spark: SparkSession, params: dict | None = None) -> dict[str, DataFrame]:
    """Six tables: accounts, opportunities, stage_history, usage_monthly, renewals, releases. All simulated.

    A won opportunity ends in the stage Closed Won, a lost one in Closed Lost, after a number of the
    stages before; each stage lasts at least a day.
    """
    p = PARAMS | (params or {})
    seed = p["seed"]
    u = lambda name, *k: _u(seed, name, *k)
    accounts = spark.range(1, p["accounts"] + 1).select(
        F.col("id").alias("account_id"), *[_choice(u(c, "id"), p[t]).alias(c) for c, t in (("industry", "industries"), ("region", "regions"), ("tier", "tiers"), ("deployment", "deployments"), ("arr_band", "arr_bands"))],
    )
    o = spark.range(1, p["opportunities"] + 1).withColumnRenamed("id", "opp_id")
    o = o.withColumn("account_id", (F.floor(u("account", "opp_id") * p["accounts"]) + 1).cast("long"))
    o = o.withColumn("created_at", F.date_add(F.lit("2024-01-01").cast("date"), F.floor(u("created", "opp_id") * 91 * p["quarters"]).cast("int")))
    o = o.withColumn("outcome", F.when(u("won", "opp_id") < p["win_rate"], "Won").otherwise("Lost"))
    o = o.withColumn("competitor", _choice(u("competitor", "opp_id"), p["competitors"]))
    o = o.withColumn("loss_reason", F.when(F.col("outcome") == "Lost", _choice(u("reason", "opp_id"), p["loss_reasons"])))
    o = o.withColumn("amount", F.round(F.exp(11 + 0.8 * _normal(seed, "amount", "opp_id")), 2))
    o = o.withColumn("steps", F.when(F.col("outcome") == "Won", 5).otherwise((F.floor(u("steps", "opp_id") * 5) + 1).cast("int")))
    names = F.array(*map(F.lit, p["stages"]))
    h = o.select("opp_id", "created_at", "outcome", "steps", F.explode(F.sequence(F.lit(1), F.col("steps") + 1)).alias("n"))
    h = h.withColumn("stage", F.when(F.col("n") <= F.col("steps"), F.element_at(names, F.col("n"))).otherwise(F.when(F.col("outcome") == "Won", "Closed Won").otherwise("Closed Lost")))
    h = h.withColumn("days", (1 + F.floor(-F.log(u("days", "opp_id", "n")) * 14)).cast("int"))
    so_far = F.coalesce(F.sum("days").over(Window.partitionBy("opp_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    h = h.withColumn("entered_at", F.date_add("created_at", so_far)).withColumn("exited_at", F.expr("date_add(entered_at, days)"))
    closed = h.groupBy("opp_id").agg(F.max("exited_at").alias("closed_at"))
    o = o.join(closed, "opp_id")
    usage = accounts.select("account_id", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2025-12-01").cast("date"), F.expr("interval 1 month"))).alias("month"))
    usage = usage.select("account_id", "month", F.explode(F.array(*map(F.lit, p["services"]))).alias("service"))
    usage = usage.withColumn("consumption_units", F.round(F.exp(4 + 0.9 * _normal(seed, "level", "account_id") + 0.4 * _normal(seed, "units", "account_id", "month", "service")), 2))
    usage = usage.withColumn("active_users", (1 + F.floor(F.exp(2 + 0.7 * _normal(seed, "users", "account_id", "service")))).cast("int"))
    renewals = accounts.select("account_id", F.date_add(F.lit("2025-01-01").cast("date"), F.floor(u("renewal", "account_id") * 365).cast("int")).alias("renewal_date"), (u("churn", "account_id") < p["churn_rate"]).alias("churn"))
    size = lambda name, rate: F.when(~F.col("churn") & (u(name, "account_id") < rate), F.round(0.05 + 0.3 * u(name + "/size", "account_id"), 4)).otherwise(0.0)
    renewals = renewals.withColumn("expansion", size("expansion", p["expansion_rate"]))
    renewals = renewals.withColumn("contraction", F.when(F.col("expansion") == 0, size("contraction", p["contraction_rate"])).otherwise(0.0))
    r = spark.range(p["quarters"] * p["sprints_per_quarter"]).select(F.col("id").alias("sprint"), F.explode(F.array(*map(F.lit, p["pm_teams"]))).alias("pm_team"))
    r = r.withColumn("planned_points", F.greatest(F.lit(5), F.round(p["points"] + 8 * _normal(seed, "planned", "sprint", "pm_team")).cast("int")))
    r = r.withColumn("delivered_points", F.greatest(F.lit(0), F.round(F.col("planned_points") * (0.75 + 0.3 * u("delivered", "sprint", "pm_team"))).cast("int")))
    r = r.withColumn("on_time", u("on_time", "sprint", "pm_team") < p["on_time_rate"])
    r = r.withColumn("planned_release_date", F.date_add(F.lit("2024-01-15").cast("date"), (F.col("sprint") * 15).cast("int")))
    r = r.withColumn("actual_release_date", F.date_add("planned_release_date", F.when(F.col("on_time"), 0).otherwise((1 + F.floor(u("slip", "sprint", "pm_team") * 14)).cast("int"))))
    return {"accounts": accounts, "opportunities": o.drop("steps"), "stage_history": h.select("opp_id", "stage", "entered_at", "exited_at"), "usage_monthly": usage, "renewals": renewals, "releases": r}


def win_rate(opps: DataFrame, by: list[str], won: Column) -> DataFrame:
    w = opps.groupBy(*by).agg(F.count("*").alias("total_opps"), F.count_if(won).alias("wins"))
    return w.withColumn("win_rate", F.round(F.col("wins").cast("double") / F.col("total_opps"), 3))


def mix_share(rows: DataFrame, within: str, part: str) -> DataFrame:
    """Counts of ``part`` and its share of each ``within``."""
    c = rows.groupBy(within, part).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(within)), 3))


def stage_durations(history: DataFrame, stage: str, entered: Column, exited: Column, key: str) -> DataFrame:
    """Entries of each stage, the mean and the median of its days, and how many different keys passed."""
    d = history.withColumn("_d", F.datediff(exited, entered))
    counts = d.groupBy(stage).agg(F.count("*").alias("entries"), F.round(F.avg("_d"), 4).alias("avg_days"), F.countDistinct(key).alias("unique_keys"))
    return with_quantiles(counts, d.select(stage, "_d"), [stage], {"median_days": ("_d", 0.5)}).withColumn("median_days", F.round("median_days", 4))


def adoption(rows: DataFrame, by: list[str], key: str, measures: dict[str, str], places: int = 4) -> DataFrame:
    return rows.groupBy(*by).agg(F.countDistinct(key).alias("accounts"), *[F.round(F.avg(c), places).alias(n) for n, c in measures.items()])


def churn_by_decile(usage: DataFrame, key: str, amount: str, outcome: DataFrame, churn: Column, contraction: Column, tiles: int = 10) -> DataFrame:
    """Churn and contraction by deciles of total usage. Usage is summed before it is joined; ties go by key."""
    total = usage.groupBy(key).agg(F.sum(amount).alias("total")).join(outcome, key)
    total = numbered(total, ["total", key], name="_at", total="_rows")
    total = total.withColumn("decile", tile(F.col("_at"), F.col("_rows"), tiles))
    out = total.groupBy("decile").agg(F.count("*").alias("accounts"), F.count_if(churn).alias("churned"), F.round(F.avg(contraction), 6).alias("avg_contraction"))
    return out.withColumn("churn_rate", F.round(F.col("churned").cast("double") / F.col("accounts"), 3))


def expansion(rows: DataFrame, by: list[str], amount: Column) -> DataFrame:
    up = amount > 0
    e = rows.groupBy(*by).agg(F.count("*").alias("accounts"), F.count_if(up).alias("expanded"), F.round(F.avg(F.when(up, amount)), 6).alias("avg_expansion"))
    return e.withColumn("expansion_rate", F.round(F.col("expanded").cast("double") / F.col("accounts"), 3))


def delivery(rows: DataFrame, by: str, planned: Column, delivered: Column, on_time: Column, slip_days: Column) -> DataFrame:
    d = rows.groupBy(by).agg(F.count("*").alias("total_sprints"), F.round(F.avg(planned), 4).alias("avg_planned"), F.round(F.avg(delivered), 4).alias("avg_delivered"), F.round(F.avg(delivered) / F.avg(planned), 4).alias("delivery_ratio"), F.round(F.count_if(on_time).cast("double") / F.count("*"), 4).alias("on_time_pct"), F.round(F.avg(slip_days), 4).alias("avg_slip_days"))
    return d
