"""Where long lineages are cut: the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def set_checkpoints(spark: SparkSession) -> None:
    """Use the session's setting; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))


#: Rows in one Arrow batch, and in one batch of the Parquet reader: texts may reach
#: hundreds of KB, so that the defaults (10,000 and 4,096 rows) would grow with them.
ARROW_ROWS, READER_ROWS = 256, 512
#: Bytes after which an Arrow batch ends before its rows are reached, unless the session names its own.
ARROW_BYTES, BYTES_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of Arrow and Parquet batches and the bytes of Arrow's, for the rest of the session."""
    for key, rows in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        if not 0 < int(spark.conf.get(key)) <= rows:
            spark.conf.set(key, str(rows))
    if spark.conf.get(BYTES_KEY, None) is None:
        spark.conf.set(BYTES_KEY, str(ARROW_BYTES))


#: Spark's switch for the removal of a query's shuffle files as soon as the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back: the lineage ends there, a lost
    executor costs a re-read, and the shuffle files of its plan go at once."""
    spark = df.sparkSession
    set_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the checkpoint folder; what is written there goes when the session ends."""
    set_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # only a path that exists can be marked for deletion
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it was counted and has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
