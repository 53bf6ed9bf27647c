"""The streamed latest view: cost of a batch, replays, half-written folders, folding."""

import os
import shutil

from pyspark.sql import functions as F

from pairloom.streaming import log

SCHEMA = "k long, o long, v string"


def _add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(folder / "in"))


def _run(spark, folder):
    stream = spark.readStream.schema(SCHEMA).json(str(folder / "in"))
    query = log.stream_latest(stream, str(folder / "changes"), ["k"], ["o"], str(folder / "cp"))
    assert query.awaitTermination(120)


def _view(spark, folder):
    return {tuple(r) for r in log.latest_view(spark, str(folder / "changes"), ["k"], ["o"]).collect()}


def _folders(folder):
    return sorted(f for f in os.listdir(folder / "changes") if f.startswith("batch="))


def test_a_batch_writes_what_it_touches_and_replays_alike(spark, tmp_path):
    _add(spark, tmp_path, [(i, 1, f"v{i}") for i in range(3_000)] + [(None, 1, "n")])
    _run(spark, tmp_path)
    _add(spark, tmp_path, [(5, 2, "new"), (6, 0, "late"), (None, 2, None), (7, 1, "a"), (7, 1, "z")])
    _run(spark, tmp_path)
    want = {(i, 1, f"v{i}") for i in range(3_000) if i not in (5, 7)} | {(5, 2, "new"), (7, 1, "z"), (None, 2, None)}
    assert _view(spark, tmp_path) == want
    second = _folders(tmp_path)[1]
    assert spark.read.parquet(str(tmp_path / "changes" / second)).count() == 4

    # the driver dies after half a folder was written and before the batch was committed
    os.remove(tmp_path / "cp" / "commits" / "1")
    crc = tmp_path / "cp" / "commits" / ".1.crc"
    if crc.exists():
        os.remove(crc)
    parts = [f for f in os.listdir(tmp_path / "changes" / second) if f.endswith(".parquet")]
    os.remove(tmp_path / "changes" / second / parts[0])
    os.remove(tmp_path / "changes" / second / "_SUCCESS")
    _run(spark, tmp_path)
    assert _view(spark, tmp_path) == want and len(_folders(tmp_path)) == 2

    # folding dies before it deletes: the copy of the folders stays beside their sum
    shutil.copytree(tmp_path / "changes", tmp_path / "kept")
    assert log.fold_changes(spark, str(tmp_path / "changes"), ["k"], ["o"]) == 2
    assert _view(spark, tmp_path) == want and len(_folders(tmp_path)) == 1
    shutil.copytree(tmp_path / "kept", tmp_path / "changes", dirs_exist_ok=True)
    assert _view(spark, tmp_path) == want
    assert log.fold_changes(spark, str(tmp_path / "changes"), ["k"], ["o"]) == 3

    # the stream goes on after the fold
    _add(spark, tmp_path, [(8, 9, "on")])
    _run(spark, tmp_path)
    assert _view(spark, tmp_path) == want - {(8, 1, "v8")} | {(8, 9, "on")}
    assert spark.conf.get(log.PROVIDER, None) != log.ON_DISK


def test_columns_of_clashing_names_and_a_stream_without_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "batch long, _row string, o long")
    assert [tuple(r) for r in log._latest(df, ["batch"], ["o"]).collect()] == [(1, "b", 2)]
    os.makedirs(tmp_path / "in")
    _run(spark, tmp_path)
    assert not (tmp_path / "changes").exists() or _view(spark, tmp_path) == set()
    assert log._latest(df.filter(F.lit(False)), ["batch"], ["o"]).count() == 0
