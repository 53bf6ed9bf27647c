"""Append-only logs as streams: latest view by micro-batches, windowed counts, resumable labelling."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order
from ..sources.writers import recover_table, replace_table


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event counts per time window; state older than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *by).count()


def maintain_latest(events: DataFrame, path: str, keys: list[str], rank: list[str], checkpoint: str):
    """Keep ``path`` as the latest row of each key while the log grows.

    A repeated micro-batch changes nothing, as the latest row is the same.
    """
    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        recover_table(spark, path)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        known = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(path))
        rows = spark.read.parquet(path).unionByName(batch) if known else batch
        replace_table(order.keep_last(rows, keys, rank), path)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Spark's state store that keeps keys on disk and writes only what changed.
PROVIDER, ON_DISK = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _latest(df: DataFrame, keys: list[str], rank: list[str]) -> DataFrame:
    """The largest row of each key by ``rank``, then by the other columns: one for any order of the rows."""
    rest = [c for c in df.columns if c not in {*keys, *rank}]
    return df.groupBy(*keys).agg(F.max(F.struct(*rank, *rest)).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def stream_latest(events: DataFrame, path: str, keys: list[str], rank: list[str], checkpoint: str):
    """Write below ``path`` the changes of the latest row of each key while the log grows.

    The latest rows are keyed state; a micro-batch writes the keys that it
    touches to a folder of its own, so its cost goes with the batch and not with
    the table.  A batch that is run again after a crash writes its folder again.
    Every row written was the latest of its key once, so half a folder, or one
    that stands twice, never makes ``latest_view`` wrong.  A key may be null; the
    columns must be orderable.
    """
    spark, run = events.sparkSession, hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={run}-{number}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ON_DISK)
    try:
        return _latest(events, keys, rank).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def latest_view(spark: SparkSession, path: str, keys: list[str], rank: list[str]) -> DataFrame:
    """The latest row of each key over the folders of changes."""
    return _latest(spark.read.parquet(f"{path}/batch=*"), keys, rank)


def fold_changes(spark: SparkSession, path: str, keys: list[str], rank: list[str]) -> int:
    """Write the view as one folder, then delete the folders that it holds; their number.

    A crash between the two steps leaves rows twice, which the view does not mind;
    folders that a stream adds meanwhile are not touched.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # only folders whose write ended: a running batch keeps its own
    found = [s.getPath() for s in fs.listStatus(hadoop(path)) if fs.exists(hadoop(s.getPath(), "_SUCCESS"))]
    if len(found) < 2:
        return 0
    _latest(spark.read.parquet(*[f.toString() for f in found]), keys, rank).write.parquet(f"{path}/batch=folded-{uuid.uuid4().hex}")
    for f in found:
        fs.delete(f, True)
    return len(found)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that a resumable job has yet to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
