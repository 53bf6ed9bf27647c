"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: the separators of the ``[^\x20\x09-\x0D]+`` words.
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Rows in one Arrow batch, and in one batch of the Parquet reader.  Texts and
#: shingle sets may reach hundreds of KB, so the defaults of 10,000 and 4,096
#: rows would let a batch of long texts grow to gigabytes.
ARROW_ROWS, READER_ROWS = 256, 512

#: A table is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of Arrow and Parquet batches for the operators that read whole texts."""
    for key, rows in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        if int(spark.conf.get(key)) > rows:
            spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without the setting (a test) gets a temporary folder
    of this machine; elsewhere the setting's absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Spark's switch for the removal of a query's shuffle files as soon as the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_leftovers(spark: SparkSession):
    """Queries inside leave no shuffle files behind; the session's own setting comes back after them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Lists of the tables written inside open ``scratch`` blocks, the innermost last.
_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables that ``materialize`` writes inside are deleted at the end, but for those
    taken out of the list that the block gives."""
    held: list[DataFrame] = []
    _SCRATCH.append(held)
    try:
        yield held
    finally:
        _SCRATCH.pop()
        discard(*held)


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    The result no longer depends on shuffle files or cached blocks, so the
    loss of an executor costs a re-read only, and the shuffle files go at once.
    The folder goes when the driver ends, or with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with without_leftovers(spark):
        df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _SCRATCH:
        _SCRATCH[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for table_ in tables:
        spark = table_.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_.written_to)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name_1``, ``name_2``, ... if ``df`` has such a column (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` marked for broadcast if its counted rows allow it, and whether they do."""
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df), True) if small else (df, False)


def salted_left_join(left: DataFrame, right: DataFrame, key: str, by: Column, salts: int = 16) -> DataFrame:
    """``left`` joined to the unique keys of ``right`` so that one hot key meets many tasks.

    Rows of ``left`` get one of ``salts`` salts from ``by``; ``right``, which
    has one narrow row a key, is repeated once a salt.
    """
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(spread, [key, "_salt"], "left").drop("_salt")


def lookup(left: DataFrame, right: DataFrame, key: str, by: Column, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` joined to the unique, non-null keys of ``right``: by broadcast if ``right``
    was counted and is small, else salted by ``by``."""
    few, small = size_checked(right, rows)
    return left.join(few, key, "left") if small else salted_left_join(left, right, key, by)


def running_totals(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` plus ``before_rank`` and a ``before_<c>`` for each of ``sums``: the rows,
    and the sum of ``c``, that stand before a row in ``order`` (which must be total).

    Rows are range-partitioned and written; one row a partition gives the
    offsets, so no task sees more than its own range.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    names = {"rank": F.lit(1).cast("long"), **{c: F.col(c) for c in sums}}
    per = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in names.items()])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_part", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_from_{n}") for n in names])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({f"before_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in names.items()})
    out = out.join(F.broadcast(offsets), "_part")  # one row a task
    return out.select(*df.columns, *[(F.col(f"before_{n}") + F.col(f"_from_{n}")).alias(f"before_{n}") for n in names])


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` words of a text; null has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    starts = F.length(F.regexp_replace(flat, "[^ ]+", "w")) - F.length(F.regexp_replace(flat, "[^ ]+", ""))
    return starts.cast("long")
