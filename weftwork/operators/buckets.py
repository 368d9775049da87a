"""Tables laid out by buckets of a key's hash: a merge reads and writes only the buckets that its rows fall in.

A table is a Parquet folder partitioned by ``_bucket``. What changes is computed from the touched
buckets, written beside the table, and then put in their place by one overwrite of these partitions,
which removes their old files. A merge that was interrupted is run again as a whole: it gives the
same rows, whichever buckets had been put in place. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators import merge as rows_
from weftwork.session import discard, materialize

BUCKET = "_bucket"


@dataclass(frozen=True)
class Buckets:
    """The table at ``path``, whose rows lie in ``n`` buckets by the hash of ``keys``. Null keys have a bucket too."""

    path: str
    keys: tuple[str, ...]
    n: int = 256

    def create(self, df: DataFrame) -> None:
        """The table anew, with the rows of ``df``."""
        df.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self.path)

    def exists(self, spark: SparkSession) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets; only their files are listed for the scan."""
        df = spark.read.parquet(self.path)
        return (df if buckets is None else df.where(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with the keys fall in: ``n`` numbers at most."""
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    def merge(self, new: DataFrame, update: list[str], order: list[Column] | None = None) -> list[int]:
        """``merge.merge`` of ``new`` into the table; returns the buckets that it has touched."""
        new = self._typed(new)
        if order is not None:
            new = rows_.latest(new, list(self.keys), order)
        return self._change(new, lambda old: rows_.merge(old, new, list(self.keys), update))

    def replace(self, new: DataFrame, parents: DataFrame) -> list[int]:
        """``merge.replace_children``: rows whose keys are among ``parents`` go, those of ``new``, whose keys must be, come."""
        new, parents = self._typed(new), self._typed(parents, list(self.keys)).distinct()
        on = [F.col(f"o.{k}").eqNullSafe(F.col(f"p.{k}")) for k in self.keys]
        return self._change(parents, lambda old: old.alias("o").join(parents.alias("p"), on, "left_anti").unionByName(new))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int").alias(BUCKET)

    def _typed(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """The columns in the types of the table: equal numbers of different types have different hashes."""
        have = {f.name: f.dataType for f in self.read(df.sparkSession).schema}
        return df.select(*[F.col(c).cast(have[c]).alias(c) for c in columns or have])

    def _change(self, rows: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        spark = rows.sparkSession
        touched = self.touched(rows)
        if not touched:
            return []
        staged = materialize(change(self.read(spark, touched)).withColumn(BUCKET, self._bucket()).repartition(BUCKET), "buckets", by=[BUCKET])
        full = {r[0] for r in staged.select(BUCKET).distinct().collect()}
        staged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for empty in set(touched) - full:  # an overwrite leaves partitions without new rows alone
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={empty}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        discard(staged)
        return touched
