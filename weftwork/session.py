"""Session factory and the few helpers that need a session: table access and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch of rows for a Python worker.
BATCH_BYTES = 4 << 20


def session(master: str = "local[*]", app: str = "weftwork", **conf) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, which Spark sends to them, and get their rows in batches
    that leave a small worker room (the setting of batches is the session's from then on)."""
    context = spark.sparkContext
    if not getattr(context, "_weftwork_sent", False):
        home = Path(__file__).resolve().parent
        packed = Path(context._temp_dir) / "weftwork.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        context.addPyFile(str(packed))
        context._weftwork_sent = True
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder; only Spark's reader opens the path."""
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores: rows that come in fewer partitions than there are cores, as from a file of one row
    group, are dealt out; others stay where they are. It changes nothing but where rows are worked on.

    Partitions are counted of plain scans only: behind a shuffle Spark chooses their number itself, and would run the shuffle to tell.
    """
    if df.isStreaming or "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or else that of the context's checkpoints.
    Where neither is set, a single machine gets a temporary one, and a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isDefined():
            found = at.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            found = f"file://{tempfile.mkdtemp(prefix='weftwork-')}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, its lineage is cut,
    and it survives the loss of any executor. ``by`` partitions the files by columns."""
    spark = reach(df.sparkSession)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def sweep(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished plan once the driver's collector finds it unused."""
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` has written, once nothing lazy reads it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        sweep(tables[0].sparkSession)
