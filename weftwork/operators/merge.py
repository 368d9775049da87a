"""Keyed changes to snapshots: a new snapshot from an old one and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` whose key is unknown are inserted; of known keys only the ``update`` columns change.

    Of rows of ``new`` with one key the last by ``order`` counts. Keys that are null match.
    """
    if order is not None:
        new = latest(new, keys, order)
    o, n = old.alias("o"), new.alias("n")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = o.withColumn("_o", F.lit(True)).alias("o").join(n.withColumn("_n", F.lit(True)).alias("n"), same, "full_outer")
    pick = lambda c: F.when(F.col("n._n").isNotNull() & (F.lit(c in update) | F.col("o._o").isNull()), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[pick(c).alias(c) for c in old.columns])


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, on: str = "document_id") -> DataFrame:
    """Children of ``parents`` are replaced by those in ``new``."""
    return old.join(parents.select(on).distinct(), on, "left_anti").unionByName(new)


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """All rows in the scopes that ``new`` has are replaced by it."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def touch_sources(old: DataFrame, new: DataFrame, run_at: Column) -> DataFrame:
    """``(name, ..., last_run)``: sources that aren't known are added, known ones get the new metadata, and all of ``new`` the time of the run."""
    new = new.withColumn("last_run", run_at)
    return merge(old, new, ["name"], [c for c in new.columns if c != "name"])


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are in one snapshot only, with ``change`` ``removed`` or ``added``."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    removed = a.join(b, [a[k].eqNullSafe(b[k]) for k in keys], "left_anti").withColumn("change", F.lit("removed"))
    added = b.join(a, [a[k].eqNullSafe(b[k]) for k in keys], "left_anti").withColumn("change", F.lit("added"))
    return removed.unionByName(added)


def fingerprint(df: DataFrame) -> list[Column]:
    """Aggregates that tell what rows a frame holds, in any order and layout: ``n``, and sums and exclusive ors of two hashes
    of 64 bits. Sums tell repeats, which an exclusive or alone would not. Columns count in the order of their names, and by type."""
    cols = [F.col(c) for c in sorted(df.columns)]
    # A null is told from nothing: a hash skips nulls.
    nulls = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    out = [F.count(F.lit(1)).alias("n")]
    for k in range(2):
        h = F.xxhash64(F.lit(k), nulls, *cols)
        out += [F.sum(h.cast("decimal(20,0)")).alias(f"sum{k}"), F.bit_xor(h).alias(f"xor{k}")]
    return out


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, equally often: by fingerprints, so that each is read once and nothing is shuffled
    but one row of a task. ``b``'s columns are taken in the types of ``a``'s. Maps can't be compared."""
    b = b.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in a.schema])
    return a.agg(*fingerprint(a)).first() == b.agg(*fingerprint(b)).first()
