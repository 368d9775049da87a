"""Corpus reports: what is in each source, who is named with whom, and how often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import ratio
from weftwork.operators.quantiles import with_quantiles


def source_report(docs: DataFrame, by: str = "source") -> DataFrame:
    """``docs(<by>, words, chars, switching)`` -> counts, medians and shares of each source."""
    counts = docs.groupBy(by).agg(F.count("*").alias("documents"), F.avg((F.col("words") < 20).cast("int")).alias("share_under_20_words"), F.count_if("switching").alias("switching"))
    return with_quantiles(counts, docs, [by], {"median_words": ("words", 0.5), "median_chars": ("chars", 0.5)})


def duplicate_rates(docs: DataFrame, drops: DataFrame, by: str = "source") -> DataFrame:
    """Drops over kept and dropped of each source; sources with either."""
    kept = docs.groupBy(by).agg(F.count("*").alias("kept"))
    gone = drops.groupBy(by).agg(F.count("*").alias("dropped"))
    both = kept.join(gone, by, "full_outer").na.fill(0, ["kept", "dropped"])
    return both.withColumn("duplicate_rate", F.coalesce(ratio(F.col("dropped"), F.col("kept") + F.col("dropped")), F.lit(0.0)))


def entity_sets(mentions: DataFrame, entities: list[str] | None = None) -> DataFrame:
    """``(document_id, entities)``, sorted and distinct."""
    m = mentions if entities is None else mentions.where(F.col("entity").isin(entities))
    return m.groupBy("document_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def entity_pairs(mentions: DataFrame, top: int | None = 10, entities: list[str] | None = None) -> DataFrame:
    """Unordered pairs of entities of one document, the most frequent first, ties by name."""
    s = entity_sets(mentions, entities)
    later = lambda x, i: F.transform(F.slice("entities", i + 2, F.size("entities")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    p = s.select(F.explode(F.flatten(F.transform("entities", later))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("documents"))
    p = p.orderBy(F.desc("documents"), "a", "b")
    return p if top is None else p.limit(top)


def share_of_voice(docs: DataFrame, mentions: DataFrame, entities: list[str], sources: list[str]) -> DataFrame:
    """``docs(id, source, switching, reason_v2)`` -> documents, shares and mentions of each entity.

    Shares are of the documents that name any of the entities, so they may sum to more than one.
    """
    m = mentions.where(F.col("entity").isin(entities)).groupBy("document_id", "entity").agg(F.sum("mention_count").alias("n"))
    d = m.join(docs.where(F.col("source").isin(sources)).select(F.col("id").alias("document_id"), "source", "switching", "reason_v2"), "document_id")
    whole = d.agg(F.countDistinct("document_id").alias("all"))
    each = d.groupBy("entity").agg(
        F.count("*").alias("documents"), F.sum("n").cast("long").alias("mentions"), F.count_if("switching").alias("switching_documents"), F.count_if("reason_v2").alias("reason_v2_documents"),
        *[F.count_if(F.col("source") == s).alias(f"docs_{s}") for s in sources],
    )
    shared = each.crossJoin(F.broadcast(whole)).withColumn("share", F.col("documents") / F.greatest("all", F.lit(1)).cast("double")).drop("all")
    return shared.orderBy(F.desc("documents"), "entity")


def margins(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of two categories with their totals, named ``total``."""
    c = df.cube(row, column).agg(F.count("*").alias("n"), F.grouping(row).alias("gr"), F.grouping(column).alias("gc"))
    name = lambda x, g: F.when(F.col(g) == 1, "total").otherwise(F.col(x)).alias(x)
    return c.select(name(row, "gr"), name(column, "gc"), "n")


def describe(df: DataFrame, x: str, places: int = 6) -> DataFrame:
    """Count, mean, deviation, extremes and five quantiles of a column."""
    out = df.agg(F.count(x).alias("n"), F.round(F.avg(x), places).alias("mean"), F.round(F.stddev_samp(x), places).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))
    names = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    out = with_quantiles(out, df, [], {n: (x, p) for n, p in names.items()})
    return out.select("n", "mean", "std", "low", *[F.round(n, places).alias(n) for n in names], "high")


def histogram(df: DataFrame, x: str, bins: int = 40, clip: float = 0.99) -> DataFrame:
    """Equal-width bins over values clipped at a quantile; the last bin is closed."""
    cap = with_quantiles(df.agg(F.min(x).alias("low")), df, [], {"cap": (x, clip)})
    v = df.select(F.col(x).cast("double").alias("v")).crossJoin(F.broadcast(cap)).withColumn("v", F.least("v", "cap"))
    i = F.when(F.col("cap") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("cap") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    return v.where("v is not null").groupBy(i.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def coverage(registry: DataFrame, ran: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """The status of each registered source: never run, run without rows, or ok."""
    r = registry.select(key).join(ran.select(key).distinct().withColumn("ran", F.lit(True)), key, "left").join(counts.select(key, "n"), key, "left")
    n = F.coalesce("n", F.lit(0))
    return r.select(key, n.cast("long").alias("n"), F.when(F.col("ran").isNull(), "never run").when(n == 0, "ran, 0 rows").otherwise("ok").alias("status"))
