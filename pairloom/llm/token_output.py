r"""Token-id output in training order.

Texts are encoded with a public byte-level vocabulary, an end token is added,
and each document is cut into sequences of ``SEQUENCE`` tokens.  A keyed
Feistel network with cycle-walking permutes the sequences' dense numbers to
global slots, and slots are cut into shards of equal length.  A record has a
fixed stride, so slot -> (shard, byte offset) is arithmetic and a reader can
resume anywhere.

Texts are encoded once and the ids written to the shared folder, two bytes a
token.  A task numbers its own sequences from zero; the tasks' totals, one row
a task, give the first number of each.  So numbering moves no tokens, whatever
the number of documents.  The sequences then go to their shards in ``ROUNDS``
range partitions of the slots, one after the other: a round moves the tokens
of its own shards only, each shard is one task, and the round's shuffle files
go before the next one starts.

The order is fixed by the key, the rows of the table and their order in it;
another split of the same table among tasks is numbered alike if it keeps that
order, else it gives another permutation of the same sequences.

Defined results: a null or empty text has no sequence; equal rows get
sequences each; null ids are allowed; an empty table gives an empty table and
a layout of no records; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir, small_batches, without_leftovers
from .token_counts import pieces, tokenizer_path

SEQUENCE = 512
#: Sequences of a shard (64 MB at a stride of 1 KB), and least shards of a run.
SHARD, MIN_SHARDS = 65_536, 64
#: Fixed values of the vocabulary byte_bpe_50k: the free id that ends a document, bytes of an id.
END, ID_BYTES = 50_256, 2
KEY, FEISTEL = "training-order-1", 6
#: Range partitions of the slots that are written one after the other.
ROUNDS = 4


@lru_cache(maxsize=2)
def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, name: str) -> bytes:
    """Little-endian ids of a text, the end token last; empty for an empty text."""
    if not text:
        return b""
    ids = array("H")
    for p in pieces(text):
        ids.extend(_encoding(name).encode_ordinary(p))
    ids.append(END)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def feistel(numbers: np.ndarray, domain: int, key: str = KEY, rounds: int = FEISTEL) -> np.ndarray:
    """A keyed permutation of range(domain), applied to ``numbers``.

    A balanced network permutes the next power of four; values outside the
    domain walk on until they fall inside.
    """
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "big")) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        with np.errstate(over="ignore"):
            for k in keys:
                f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(numbers.astype(np.uint64))
    while (walk := out >= np.uint64(domain)).any():
        out[walk] = once(out[walk])
    return out.astype(np.int64)


def _encoded(name: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            tokens = [encode(t, name) for t in batch.column(1).to_pylist()]
            seqs = np.array([-(-len(t) // (length * ID_BYTES)) for t in tokens], np.int64)
            firsts = first + np.cumsum(seqs) - seqs
            first += int(seqs.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(seqs), task, np.int32)), pa.array(firsts), pa.array(seqs), pa.array(tokens, pa.binary())],
                names=["doc_id", "task", "first", "n_seqs", "ids"])

    return run


def _sequences(length: int, total: int, key: str, low: int, high: int):
    """Arrow pass over (doc_id, start, n_seqs, ids): the sequences with slots in [low, high)."""
    names = ["slot", "doc_id", "seq", "n_tokens", "tokens"]
    step = length * ID_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, counts = (batch.column(k).to_numpy() for k in (1, 2))
            owner = np.repeat(np.arange(len(counts)), counts)
            seq = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            slots = feistel((starts[owner] + seq).astype(np.uint64), total, key) if len(owner) else np.zeros(0, np.int64)
            mine = np.flatnonzero((slots >= low) & (slots < high))
            owner, seq = owner[mine], seq[mine]
            offsets = np.frombuffer(batch.column(3).buffers()[1], np.int32)[batch.column(3).offset :][: len(counts) + 1].astype(np.int64)
            data = memoryview(batch.column(3).buffers()[2] or b"")
            begin = offsets[:-1][owner] + seq * step
            end = np.minimum(begin + step, offsets[1:][owner])
            payload = [data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots[mine]), batch.column(0).take(pa.array(owner)), pa.array(seq), pa.array((end - begin) // ID_BYTES), pa.array(payload, pa.binary())], names=names)

    return run


def _store(folder: str):
    """File system and path of a folder: a local path, or a URI as ``qualified`` gives it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1)) if ":/" in folder else (fs.LocalFileSystem(), folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark would give it, so that executors and driver mean the same store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _rename(store, old: str, new: str) -> None:
    """Not every store renames over a file that an earlier attempt left."""
    if store.type_name != "local" and store.get_file_info(new).is_file:
        store.delete_file(new)
    store.move(old, new)


def _put(folder: str, name: str, held: dict) -> None:
    store, path = _store(folder)
    tmp = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        f.write(json.dumps(held).encode())
    _rename(store, tmp, f"{path}/{name}")


def _shard_writer(folder: str, stride: int, per_shard: int):
    """Arrow pass over rows sorted by slot: writes the shards, gives (slot, doc_id, seq, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, tmp, digest, records = None, None, None, None, 0
        store, path = _store(folder)

        def close() -> None:
            if out is not None:
                out.close()
                name = f"shard-{now:08d}"
                _rename(store, tmp, f"{path}/{name}.bin")
                _put(folder, f"{name}.json", {"shard": now, "records": records, "sha256": digest.hexdigest()})

        for batch in batches:
            for slot, tokens in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if slot // per_shard != now:
                    close()
                    now, digest, records = slot // per_shard, hashlib.sha256(), 0
                    # a name of its own, renamed when whole: a repeated task changes nothing
                    tmp = f"{path}/.shard-{now:08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(tmp, buffer_size=1 << 20)
                record = tokens + END.to_bytes(ID_BYTES, "little") * ((stride - len(tokens)) // ID_BYTES)
                out.write(record)
                digest.update(record)
                records += 1
            yield batch.select(["slot", "doc_id", "seq", "n_tokens"])
        close()

    return run


INDEX = "slot long, doc_id long, seq long, n_tokens long"


def write_order(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.tiktoken", length: int = SEQUENCE, key: str = KEY,
                shard_sequences: int = SHARD, rounds: int = ROUNDS) -> dict:
    """Write the documents' sequences to ``folder`` in training order; returns the layout.

    ``shard-N.bin`` has records of a fixed stride, padded with the end token,
    ``shard-N.json`` their number and sha256, ``index/`` the document, place
    and length of every slot, and ``layout.json`` stride, records of a shard and
    records; the layout is written last, when all shards stand.  A folder that
    holds an order, or a part of one, is refused.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder)
    store, path = _store(folder)
    if any(found.type for found in store.get_file_info([f"{path}/index", f"{path}/layout.json"])):
        raise FileExistsError(f"{folder} holds an order already")
    store.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text <> ''")
    rows = materialize(rows.mapInArrow(_encoded(tokenizer, length), "doc_id long, task int, first long, n_seqs long, ids binary"), "zstd")
    totals = rows.groupBy("task").agg(F.sum("n_seqs").alias("all"))
    before = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("task").alias("_task"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))  # one row a task
    total = totals.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    numbered = rows.join(F.broadcast(offsets), F.col("task") == F.col("_task")).select("doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_seqs", "ids")
    per_shard = max(1, min(shard_sequences, -(-total // MIN_SHARDS)))
    stride, shards = length * ID_BYTES, -(-total // per_shard)
    layout = {"stride": stride, "per_shard": per_shard, "records": total, "shards": shards}
    for r in range(rounds):
        first, last = shards * r // rounds, shards * (r + 1) // rounds
        if first == last:
            continue
        part = numbered.mapInArrow(_sequences(length, total, key, first * per_shard, last * per_shard), f"{INDEX}, tokens binary")
        part = part.repartitionById(last - first, (F.floor(F.col("slot") / per_shard) - first).cast("int")).sortWithinPartitions("slot")
        with without_leftovers(spark):
            part.mapInArrow(_shard_writer(folder, stride, per_shard), INDEX).write.mode("append").parquet(f"{folder}/index")
    discard(rows)
    _put(folder, "layout.json", layout)
    return layout


def read_layout(folder: str) -> dict:
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/layout.json") as f:
        return json.loads(f.read())


ROW = "slot long, shard long, byte_offset long, doc_id long, seq long, n_tokens long, tokens binary"


def read_order(spark: SparkSession, folder: str, first: int = 0) -> DataFrame:
    """The sequences from slot ``first`` on, read back from the shards: slot, shard,
    byte_offset, doc_id, seq, n_tokens, tokens (little-endian ids, without padding)."""
    folder = qualified(spark, folder)
    layout = read_layout(folder)
    if not layout["records"]:
        return spark.createDataFrame([], ROW)
    stride, per_shard = layout["stride"], layout["per_shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        now, file, at = None, None, 0
        for batch in batches:
            slots = batch.column(0).to_numpy()
            payload = []
            for slot, n in zip(slots.tolist(), batch.column(3).to_pylist(), strict=True):
                if slot // per_shard != now:
                    if file is not None:
                        file.close()
                    now, at = slot // per_shard, None
                    file = store.open_input_file(f"{path}/shard-{now:08d}.bin")
                if slot != at:
                    file.seek(slot % per_shard * stride)
                payload.append(file.read(stride)[: n * ID_BYTES])
                at = slot + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(slots // per_shard), pa.array(slots % per_shard * stride), *[batch.column(k) for k in (1, 2, 3)], pa.array(payload, pa.binary())],
                names=[c.split(" ")[0] for c in ROW.split(", ")])

    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    return (index.filter(F.col("slot") >= first) if first else index).mapInArrow(run, ROW)


def written_order(docs: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """``write_order`` into ``folder`` (by default a new one in the shared folder), read back
    with ``read_order``; the folder is the result's ``written_to``."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_order(docs, folder, **settings)
    out = read_order(spark, folder)
    out.written_to = qualified(spark, folder)
    return out


def read_slots(folder: str, first: int = 0) -> Iterator[tuple[int, bytes]]:
    """(slot, record) in training order, from slot ``first`` on."""
    store, path = _store(folder)
    layout = read_layout(folder)
    stride, per_shard = layout["stride"], layout["per_shard"]
    while first < layout["records"]:
        shard, at = divmod(first, per_shard)
        with store.open_input_file(f"{path}/shard-{shard:08d}.bin") as f:
            f.seek(at * stride)
            for slot in range(first, min((shard + 1) * per_shard, layout["records"])):
                record = f.read(stride)
                if len(record) != stride:
                    raise ValueError(f"shard {shard} ends before slot {slot}")
                yield slot, record
        first = (shard + 1) * per_shard
