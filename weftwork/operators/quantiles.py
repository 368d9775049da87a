"""Exact quantiles of groups of any size, in bounded memory: bracketed by a sketch, selected by counting.

A mergeable sketch gives, for each group and quantile, two values between which the wanted ranks lie.
One pass counts what is below a bracket and in it, which proves or corrects it; while a bracket holds
more values than ``most``, what lies in it is sketched again, which leaves some hundredth of it. Then the
few values in each bracket are counted one by one, and the wanted ranks are read off running sums.
Nothing but sketches of fixed size and brackets of bounded size is ever in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.session import materialize

#: Values in a bracket that are counted one by one, at most, but for equal ones; precision of a sketch.
MOST, ACCURACY = 50_000, 1000


def exact_quantiles(df: DataFrame, by: list[str], columns: list[str], probabilities: list[float], most: int = MOST) -> DataFrame:
    """``(by..., column, p, value)``: the quantile ``p`` of each column in each group, interpolated between the two values
    nearest to the place ``p * (n - 1)``.

    Nulls don't count; a group without values has no rows; NaN is larger than any number. A group key may be null. Without ``by`` all rows are one
    group. Values are compared as doubles.
    """
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    values = df.select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.explode(each).alias("e")).select("g", "e.column", "e.x").where("x is not null")
    values = materialize(values, "quantile-values")
    sizes = values.groupBy("g", "column").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    # k and k + 1 are the places of the two values, from 0; below: values under the bracket; within: those between its ends, which may be equal to very many.
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    t = sizes.withColumn("p", F.explode(ps)).withColumn("at", F.col("p") * (F.col("n") - 1))
    t = t.select("g", "column", "p", "at", "n", F.floor("at").alias("k"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.col("n").alias("within"))
    targets = materialize(t, "quantile-targets")
    wide = (F.col("within") > most) & (F.col("low") < F.col("high"))
    for _ in range(16):
        if targets.where(wide).isEmpty():
            break
        targets = materialize(_narrowed(values, targets, wide), "quantile-targets")
    else:
        raise RuntimeError("brackets don't narrow")
    few = _within(values, targets).groupBy("g", "column", "p", "x").agg(F.count("*").alias("m"))
    order = Window.partitionBy("g", "column", "p").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = few.withColumn("up_to", F.sum("m").over(order)).join(targets.select("g", "column", "p", "at", "k", "n", "below"), ["g", "column", "p"])
    up_to = F.col("below") + F.col("up_to")
    holds = lambda place: (up_to - F.col("m") <= place) & (place < up_to)
    two = few.groupBy("g", "column", "p").agg(F.max(F.when(holds(F.col("k")), F.col("x"))).alias("a"), F.max(F.when(holds(F.least(F.col("k") + 1, F.col("n") - 1)), F.col("x"))).alias("b"), F.max(F.col("at") - F.col("k")).alias("part"))
    # Equal values need no arithmetic, which infinite ones couldn't bear.
    value = F.when((F.col("a") == F.col("b")) | (F.col("part") == 0), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return two.select(*[F.col("g")[c].alias(c) for c in by], "column", "p", value.alias("value"))


def _within(values: DataFrame, targets: DataFrame) -> DataFrame:
    """The values in each bracket."""
    both = values.join(targets.select("g", "column", "p", "low", "high"), ["g", "column"])
    return both.where("x >= low and x <= high").select("g", "column", "p", "x")


def _narrowed(values: DataFrame, targets: DataFrame, wide: Column) -> DataFrame:
    """Brackets of targets that are ``wide``, about their places by a sketch of what is in them; they stay as they are if they miss one."""
    some = targets.where(wide)
    marks = [i / ACCURACY for i in range(ACCURACY + 1)]
    sketched = _within(values, some).groupBy("g", "column", "p").agg(F.percentile_approx("x", F.array(*map(F.lit, marks)), F.lit(10 * ACCURACY)).alias("marks"))
    place = ((F.col("k") - F.col("below")) / F.col("inside") * ACCURACY).cast("int")
    # A place or two more, as marks are rounded to places.
    more = F.ceil(F.lit(2 * ACCURACY) / F.col("inside")).cast("int")
    mark = lambda i: F.element_at("marks", F.least(F.greatest(i, F.lit(0)), F.lit(ACCURACY)) + 1)
    tried = some.join(sketched, ["g", "column", "p"]).select("g", "column", "p", F.greatest("low", mark(place - 1 - more)).alias("lo"), F.least("high", mark(place + 2 + more)).alias("hi"))
    counted = values.join(tried, ["g", "column"]).groupBy("g", "column", "p").agg(F.count_if(F.col("x") < F.col("lo")).alias("under"), F.count_if(F.col("x").between(F.col("lo"), F.col("hi"))).alias("held"), F.count_if((F.col("x") > F.col("lo")) & (F.col("x") < F.col("hi"))).alias("apart"))
    new = targets.join(tried, ["g", "column", "p"], "left").join(counted, ["g", "column", "p"], "left")
    last = F.least(F.col("k") + 1, F.col("n") - 1)
    right = F.coalesce((F.col("under") <= F.col("k")) & (last < F.col("under") + F.col("held")), F.lit(False))
    pick = lambda old, better: F.when(right, F.col(better)).otherwise(F.col(old)).alias(old)
    return new.select("g", "column", "p", "at", "n", "k", pick("low", "lo"), pick("high", "hi"), pick("below", "under"), pick("inside", "held"), pick("within", "apart"))


def with_quantiles(grouped: DataFrame, rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]], most: int = MOST) -> DataFrame:
    """``grouped``, one row for each group, with quantiles of ``rows``: a column name -> (column, p)."""
    ps = sorted({p for _, p in wanted.values()})
    q = exact_quantiles(rows, by, sorted({c for c, _ in wanted.values()}), ps, most)
    q = q.groupBy(*by).agg(*[F.max(F.when((F.col("column") == c) & (F.col("p") == p), F.col("value"))).alias(name) for name, (c, p) in wanted.items()])
    if not by:
        return grouped.crossJoin(q)  # one row each
    q = q.select(*[F.col(c).alias(f"_{c}") for c in by], *wanted)
    return grouped.join(q, [grouped[c].eqNullSafe(q[f"_{c}"]) for c in by], "left").select(*[grouped[c] for c in grouped.columns], *wanted)
