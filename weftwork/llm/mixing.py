"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Every document has 36 bits of a keyed hash of its id. Its source's words are summed by the first
12 bits, and the running sum over these 4,096 buckets shows in which one the budget of the source
ends. Only documents of that bucket are summed again by the next 12 bits, and then by the last 12.
The three boundaries are one threshold: documents below it are taken. Nothing is sorted but
histograms, and a larger budget takes a superset of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)
_DIGITS = 3  # hexadecimal digits of a level: 12 bits


def word_count(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]``; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` -> with ``target``.

    Sources in order of code points, null last, have the weights in turn and share ``share`` times
    all words. A target stops at ``most`` times its source; the excess goes to the others by weight
    until none is above. In order of cap over weight the capped sources are the first ones, so that
    one running sum finds them all. The window runs over sources, of which each is one row here.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.array(*map(F.lit, weights))
    s = sizes.withColumn("w", F.element_at(w, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("left", share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("rate", F.col("left") / F.col("weight_left"))
    # The rate grows while capped sources leave, and falls once others do: of those that a source can have, the largest counts.
    s = s.withColumn("rate", F.max(F.when(F.col("w") * F.col("rate") <= F.col("cap"), F.col("rate"))).over(whole))
    capped = F.col("rate").isNull() | (F.col("w") * F.col("rate") > F.col("cap"))
    return s.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("w") * F.col("rate")).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    key: str = "mix-1",
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``docs`` -> ``(doc_id, size, source_size, target, taken)``, one row for each row.

    A document is taken as often as its source's target holds the whole source, and once more if
    its hash is below the source's threshold, so that a source's taken words are within about one
    document of its target. Rows repeated under one doc_id have one hash and are taken alike. A null
    doc_id has a hash like any other; a null text has no words; null is a source, the last one. Empty
    tables give empty results; extra columns don't matter. Runs with one key agree.
    """
    h = F.substring(F.md5(F.concat(F.lit(f"{key}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, 3 * _DIGITS)
    d = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), h.alias("h")), "mix-sizes")
    aim = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    base = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")))
    aim = aim.withColumn("base", base.cast("long")).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    aim = materialize(aim, "mix-targets")

    edge = aim.select(F.col("source").alias("of"), "budget", F.lit("").alias("cut"))
    for level in range(3):
        digits = _DIGITS * (level + 1)
        inside = d.join(edge, d["source"].eqNullSafe(edge["of"]) & F.col("h").startswith(F.col("cut")))
        sums = inside.groupBy("of", "budget", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("size").alias("n"))
        up_to = F.sum("n").over(Window.partitionBy("of").orderBy("bucket"))
        sums = sums.withColumn("up_to", up_to)
        # The bucket in which the budget ends: the first whose running sum is above it.
        first = sums.where("up_to > budget").groupBy("of").agg(F.min(F.struct("bucket", "up_to", "n", "budget")).alias("x"))
        edge = first.select("of", (F.col("x.budget") - (F.col("x.up_to") - F.col("x.n"))).alias("budget"), F.col("x.bucket").alias("cut"), F.col("x.n").alias("n"))
        edge = materialize(edge, "mix-edge")
    # The last bucket is one document, or a few; it is taken if that brings the sum nearer to the budget.
    edge = edge.select("of", "cut", (F.col("n") - F.col("budget") < F.col("budget")).alias("with"))
    plan = aim.join(edge, aim["source"].eqNullSafe(edge["of"]), "left").select(aim["source"].alias("of"), "source_size", "target", "base", "cut", "with")
    once_more = F.col("cut").isNull() & (F.col("target") > F.col("base") * F.col("source_size")) | (F.col("h") < F.col("cut")) | (F.col("h") == F.col("cut")) & F.col("with")
    times = F.col("base") + F.when(once_more, 1).otherwise(0)
    return d.join(plan, d["source"].eqNullSafe(plan["of"])).select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))
