"""Session construction and the shared folder used for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "cohortlens", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides.

    Adaptive execution splits skewed join partitions and picks broadcast joins
    from measured sizes; operators hint a broadcast only for sides whose size
    they have checked or know to be bounded.  On a cluster pass
    ``spark__checkpoint__dir``, a folder that all executors share.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of ``spark.checkpoint.dir`` for a written table.

    The cluster names that folder.  Without one a session in a single process
    (unit tests) makes and sets a temporary one; any other raises, as executors
    would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cohortlens-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cohortlens/{name}-{uuid.uuid4().hex[:12]}"


def written(df, name: str):
    """``df`` written as Parquet to the shared folder and read back.

    Used where one result feeds many jobs: the lineage is cut by a table any
    executor can read, so a lost executor costs a file read and no recompute.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

INFERENCE = "spark.sql.constraintPropagation.enabled"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
MANY_COLUMNS = 6


def allow_wide(df, columns) -> None:
    """Session settings for plans over many computed columns; they can be
    changed at run time and stay as the user set them otherwise.

    * The JVM does not compile methods above 8,000 bytes of code, and a fused
      stage over a few recoded items is larger: it would run interpreted, about
      ten times slower.  With this limit Spark splits such expressions instead.
    * Filter inference substitutes every computed column in every known
      constraint, which doubles their number per column: with a few dozen
      recoded items planning would never end.  All it would add here are
      not-null filters on join keys.
    """
    conf = df.sparkSession.conf
    if int(conf.get(METHOD_LIMIT, "65535")) > 8000:
        conf.set(METHOD_LIMIT, "8000")
    if len(columns) > MANY_COLUMNS and conf.get(INFERENCE, "true") == "true":
        conf.set(INFERENCE, "false")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for plans whose rows are whole blocks of a table, unless
    the user has set a size.  A task holds a batch several times, outside of the
    heap and in Python, so that Spark's 64 MB take about a GB of an executor."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "8m")
