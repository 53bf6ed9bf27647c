r"""Substring deduplication by hashing lines, grouped into paragraphs.

Units: a text is cut after every line break and after every white-space
character that follows ``.``, ``!`` or ``?``, so a line is one unit a sentence
and prose that stands on one long line is cut too.  Units are normalised (A-Z
lower-cased, words ``[^\x20\x09-\x0D]+`` joined by one blank) and hashed to
128 bits.  Digests are grouped over all documents, and the occurrence ranked
first by (id, text digest, unit) is the one that stays.

A unit is a repeat if its first occurrence stands in another document.  Short
units repeat by chance, so what goes is a paragraph: repeats that follow each
other, of ``MIN_WORDS`` words together or more (units without words neither
count nor interrupt).  Removed units keep their offsets in the original text;
the white-space character that ends a unit goes with it.  With ``within``,
later occurrences in the first occurrence's own document are repeats too.

The group step pre-aggregates, so a unit that a third of all documents share
is one row a task.  Digests of more than one document go back to the units in
two ways: those with more than one in ``HOT_SHARE`` of all units, at most
``HOT_SHARE`` digests, by broadcast; the rest by a join whose keys are rare.

Defined results: a null text is empty and stays null; rows with the same id
and text are one document, so equal rows keep the same units; rows with the
same id and other texts are documents of their own; a null id ranks first; an
empty table gives an empty table; extra columns of any name are passed by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, small_batches

#: Words that neighbouring repeats have together before they go.
MIN_WORDS = 25
#: A digest with more than one in so many units (and ``HOT_LEAST`` at least) is hot.
HOT_SHARE, HOT_LEAST = 50_000, 5_000
_CUT = re.compile(r"\n|(?<=[.!?])[\x20\x09-\x0D]")


def units(text: str | None) -> Iterator[tuple[int, int, bytes, int]]:
    """(start, end, normal form, words) of the units that have words."""
    at = 0
    text = text or ""
    for stop in [m.end() for m in _CUT.finditer(text)] + [len(text)]:
        words = text[at:stop].encode("utf-8", "surrogatepass").lower().split()
        if words:
            yield at, stop, b" ".join(words), len(words)
        at = stop


#: Units of one batch that the first pass hands on.
_FLUSH = 20_000


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owners, places, digests = [], [], []

        def emit() -> pa.RecordBatch:
            table = np.array(places, np.int32).reshape(-1, 4)
            pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            owner = pa.array(owners, pa.int32())
            made = pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), *[pa.array(table[:, k].copy()) for k in range(4)], pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())],
                names=["id", "hash", "unit", "words", "start", "end", "high", "low"])
            for held in (owners, places, digests):
                held.clear()
            return made

        for row in range(batch.num_rows):
            for unit, (start, end, norm, words) in enumerate(units(batch.column(2)[row].as_py())):
                owners.append(row)
                places.append((unit, words, start, end))
                digests.append(xxhash.xxh3_128_digest(norm))
                if len(digests) >= _FLUSH:
                    yield emit()
        yield emit()


UNIT_ROW = "id long, hash long, unit int, words int, start int, end int, high long, low long"
REMOVED = "array<struct<unit:int,start:int,end:int,kept_id:bigint,kept_unit:int>>"


def _paragraphs(min_words: int):
    """Arrow pass: of every document's repeats, those in runs of ``min_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            repeats = lists.flatten()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            unit, words = repeats.field("unit").to_numpy(), repeats.field("words").to_numpy()
            opens = np.ones(len(unit), bool)
            opens[1:] = (row[1:] != row[:-1]) | (unit[1:] != unit[:-1] + 1)
            runs = np.cumsum(opens) - 1
            kept = np.flatnonzero(np.bincount(runs, words)[runs] >= min_words) if len(unit) else np.zeros(0, np.int64)
            counts = np.bincount(row[kept], minlength=len(lists))
            docs = np.flatnonzero(counts)
            chosen = repeats.take(pa.array(kept))
            names = ["unit", "start", "end", "kept_id", "kept_unit"]
            found = pa.StructArray.from_arrays([chosen.field(n) for n in names], names=names)
            ends = np.concatenate([[0], np.cumsum(counts[docs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs)), batch.column(1).take(pa.array(docs)), pa.ListArray.from_arrays(pa.array(ends), found)], names=["id", "hash", "removed"])

    return run


def removals(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text", within: bool = False,
             hot_share: int = HOT_SHARE, hot_least: int = HOT_LEAST) -> DataFrame:
    """(id, hash, removed) of the documents that lose units; ``removed`` holds each
    unit's number and offsets, and the document and unit that stay for it."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    rows = materialize(plain.mapInArrow(_unit_rows, UNIT_ROW))
    # nulls sort first in a struct's minimum, which is the rank that null ids have
    place = F.struct("id", "hash", "unit")
    first = rows.groupBy("high", "low").agg(F.min(place).alias("kept"), F.max(place).alias("_last"), F.count(F.lit(1)).alias("times"))
    elsewhere = ~(F.col("kept.id").eqNullSafe(F.col("_last.id")) & (F.col("kept.hash") == F.col("_last.hash")))
    again = materialize(first.filter(F.col("times") > 1 if within else elsewhere).select("high", "low", "kept", "times"))
    limit = max(hot_least, rows.count() // hot_share)
    hot, rare = again.filter(F.col("times") > limit).drop("times"), again.filter(F.col("times") <= limit).drop("times")
    hot = F.broadcast(hot.withColumnsRenamed({"high": "_high", "low": "_low", "kept": "_kept"}))  # hot_share rows at most
    marked = rows.join(hot, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")), "left").drop("_high", "_low")
    found = marked.filter("_kept is not null").withColumnRenamed("_kept", "kept").unionByName(marked.filter("_kept is null").drop("_kept").join(rare, ["high", "low"]))
    own = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("hash") == F.col("kept.hash"))
    found = found.filter(~(own & (F.col("unit") == F.col("kept.unit"))) if within else ~own)
    item = F.struct("unit", "words", "start", "end", F.col("kept.id").alias("kept_id"), F.col("kept.unit").alias("kept_unit"))
    per = found.groupBy("id", "hash").agg(F.array_sort(F.collect_set(item)).alias("repeats"))
    return per.mapInArrow(_paragraphs(min_words), f"id long, hash long, removed {REMOVED}")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """``docs`` with the text left after removal, plus ``removed`` (null if nothing
    went): array<struct<unit, start, end, kept_id, kept_unit>> in order.  If
    ``docs`` has a column ``removed``, the new one is the first free ``removed_N``."""
    gone = materialize(removals(docs, min_words, id_col, text, within)).select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "removed")
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_i"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    out = held.join(gone, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    # what stays are the stretches between the removed ones
    none = F.array(F.lit(0))
    starts, ends = F.transform("removed", lambda r: r["start"]), F.transform("removed", lambda r: r["end"])
    gaps = F.arrays_zip(F.concat(none, ends).alias("a"), F.concat(starts, F.array(F.length("_text"))).alias("b"))
    left = F.array_join(F.transform(F.filter(gaps, lambda g: g["a"] < g["b"]), lambda g: F.substring(F.col("_text"), g["a"] + 1, g["b"] - g["a"])), "")
    kept = F.when(F.col("removed").isNull(), F.col("_text")).otherwise(left)
    return out.select(*[(kept if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns], F.col("removed").alias(free_name(docs, "removed")))


def dedup_rows(docs: DataFrame) -> DataFrame:
    """One row a document: what went, where it stood, and the text that is left.

    ``n_chars`` is the length of the text left, ``n_chars_before`` of the original.
    """
    out = dedup_lines(docs.select("doc_id", "text", F.length("text").cast("long").alias("n_chars_before")))
    spans = F.array_join(F.transform("removed", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",")
    return out.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.coalesce("n_chars_before", F.lit(0)).alias("n_chars_before"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
        F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"]), F.lit(0)).alias("removed_chars"),
        F.coalesce(spans, F.lit("")).alias("removed_spans"), "text")
