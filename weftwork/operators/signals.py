"""Event series by calendar month (or any unit that ``trunc`` knows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled_series(events: DataFrame, by: list[str], at: Column, unit: str = "month") -> DataFrame:
    """``(by..., period_start, new, cumulative)``: events of each period, with zeros from the first to the last of a group."""
    period = F.to_date(F.date_trunc(unit, at))
    n = events.groupBy(*by, period.alias("period_start")).agg(F.count("*").alias("new"))
    step = F.expr(f"interval 1 {unit}")
    span = n.groupBy(*by).agg(F.min("period_start").alias("low"), F.max("period_start").alias("high"))
    span = span.select(*by, F.explode(F.sequence("low", "high", step)).alias("period_start"))
    full = span.join(n, [*by, "period_start"], "left").withColumn("new", F.coalesce("new", F.lit(0)).cast("long"))
    w = Window.partitionBy(*by).orderBy("period_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.withColumn("cumulative", F.sum("new").over(w))


def velocity(rows: DataFrame, by: list[str], opened: Column, closed: Column, floor: Column, unit: str = "month") -> DataFrame:
    """``(by..., period_start, metric, value)``: rows opened and closed in each period from ``floor`` on, without zeros."""
    both = rows.select(*by, floor.alias("floor"), F.explode(F.array(F.struct(F.lit("opened").alias("metric"), opened.alias("at")), F.struct(F.lit("closed").alias("metric"), closed.alias("at")))).alias("x"))
    both = both.where("x.at is not null").withColumn("period_start", F.to_date(F.date_trunc(unit, F.col("x.at"))))
    both = both.where(F.col("period_start") >= F.to_date(F.date_trunc(unit, F.col("floor"))))
    return both.groupBy(*by, "period_start", F.col("x.metric").alias("metric")).agg(F.count("*").cast("double").alias("value"))


def summary(signals: DataFrame) -> DataFrame:
    """Rows, entities and span of each signal type."""
    return signals.groupBy("signal_type").agg(F.count("*").alias("n_rows"), F.countDistinct("entity").alias("entities"), F.min("period_start").alias("first"), F.max("period_start").alias("last"))
