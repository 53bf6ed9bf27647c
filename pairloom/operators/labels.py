"""Training data shapes: edit labels and their inverse, masking, encoding, run tables."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import backtrace
from . import order

LABEL = "array<struct<label:string,text:string>>"
END = "<end>"
MAX_SYMBOLS = 200_000


def label_edits(source: list[str], target: list[str], slots: int = 4) -> list[tuple[str, str]]:
    """One label a source item and one for the end: keep, delete, substitute, or
    expand (inserted items go with the position before which they stand)."""
    return _labels(backtrace(source, target), slots)


def _labels(path: list, slots: int) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    waiting: list[str] = []
    for op, _, t in [*path, ("keep", END, END)]:
        if op == "insert":
            waiting.append(t)
            if len(waiting) >= slots:
                raise ValueError(f"more than {slots - 1} inserted items at one place")
            continue
        own = [] if op == "delete" else [t]
        if waiting:
            out.append(("expand", "\x1f".join([*waiting, *own])))
        else:
            out.append((op, "" if op == "delete" else t))
        waiting = []
    return out


def edit_labels(source: Column, target: Column, slots: int = 4) -> Column:
    """array<struct<label, text>> over the source tokens and the end slot."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("text", pa.string())]))

    @F.arrow_udf(LABEL)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([[{"label": k, "text": t} for k, t in label_edits(x or [], y or [], slots)] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    return run(source, target)


def apply_labels(labels: Column) -> Column:
    """The target tokens of an edit script, in the JVM."""
    parts = F.transform(labels, lambda x: F.when(x["label"] == "delete", F.array().cast("array<string>")).otherwise(F.split(x["text"], "\x1f")))
    return F.filter(F.flatten(parts), lambda t: t != END)


def segment_lengths(labels: Column) -> Column:
    """Items that each label writes: for substitute and expand only, else null, so that
    the common lengths of kept items do not drown the rest."""
    return F.transform(labels, lambda x: F.when(x["label"].isin("substitute", "expand"), F.size(F.split(x["text"], "\x1f"))))


def label_profile(pairs: DataFrame, source: str, target: str, slots: int = 16) -> DataFrame:
    """(family, label, count): operations and lengths of the edit labels, boundaries and word labels.

    A path is made once for each distinct pair, serves all four families, and only
    counts leave a task.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for x, y, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = x or "", y or ""
                path = backtrace(list(x), list(y))
                marks, _, words = _boundaries(x, path)
                for family, labels in (("boundary", marks), ("word", words)):
                    for label in labels:
                        found[family, label] += n
                for label, text in _labels(path, slots):
                    found["operation", label] += n
                    if label in ("substitute", "expand"):
                        found["length", str(text.count("\x1f") + 1)] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.string()) for i in (0, 1)] + [pa.array(list(found.values()), pa.int64())], names=["family", "label", "count"])

    each = pairs.groupBy(F.col(source).alias("s"), F.col(target).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    # a given number of parts, as short pairs would be gathered in a few tasks
    spread = each.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(count, "family string, label string, count long").groupBy("family", "label").agg(F.sum("count").alias("count"))


def boundary_labels(source: str, target: str) -> tuple[list[str], list[int], list[str]]:
    """Labels of one character alignment: (boundaries, word numbers, word labels).

    A blank of the source is kept or deleted; another character may have a
    blank inserted before it.  A word is edited if any of its characters is
    changed, or one is inserted into or after it.
    """
    return _boundaries(source, backtrace(list(source), list(target)))


def _boundaries(source: str, path: list) -> tuple[list[str], list[int], list[str]]:
    pieces: list[list[str]] = [[] for _ in range(len(source) + 1)]
    words, inside, last = [], False, -1
    for c in source:
        last += c != " " and not inside
        inside = c != " "
        words.append(last if inside else -1)
    edited: set[int] = set()

    def touch(at: int) -> None:
        for k in (at, at - 1):
            if 0 <= k < len(words) and words[k] >= 0:
                edited.add(words[k])
                return

    at = 0
    for op, s, t in path:
        if op == "insert":
            pieces[at].append(t)
            if t != " ":
                touch(at)
            continue
        if op != "delete":
            pieces[at].append(t)
        if op == "delete" and s != " " or op == "substitute" and not s == t == " ":
            touch(at)
        at += 1
    marks = [
        ("keep" if " " in p else "delete") if c == " " else ("insert_before" if p[:1] == [" "] else "none")
        for c, p in zip(source, pieces, strict=False)]
    return marks, words, ["edit" if w in edited else "keep" for w in range(last + 1)]


def hybrid_labels(source: Column, target: Column) -> Column:
    """struct<boundaries, word_ids, word_labels> of a string pair."""
    kind = pa.struct([("boundaries", pa.list_(pa.string())), ("word_ids", pa.list_(pa.int32())), ("word_labels", pa.list_(pa.string()))])

    @F.arrow_udf("struct<boundaries:array<string>,word_ids:array<int>,word_labels:array<string>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("boundaries", "word_ids", "word_labels"), boundary_labels(x or "", y or ""), strict=True)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    return run(source, target)


def mask_spans(tokens: Column, key: Column, seed: int = 2026, share: float = 0.15) -> Column:
    """array<struct<token, target>>: keyed choice of positions; 80 % masked, 10 %
    swapped for another token of the row, 10 % kept."""
    kind = pa.list_(pa.struct([("token", pa.string()), ("target", pa.string())]))

    @F.arrow_udf("array<struct<token:string,target:string>>")
    def run(words: pa.Array, keys: pa.Array) -> pa.Array:
        rows = []
        for row, k in zip(words.to_pylist(), keys.to_pylist(), strict=True):
            rng = random.Random(f"{seed}:{k}")
            row = row or []
            chosen = set(rng.sample(range(len(row)), max(1, round(share * len(row))))) if row else set()
            out = []
            for i, t in enumerate(row):
                u = rng.random()
                new = t if i not in chosen or u >= 0.9 else "<mask>" if u < 0.8 else rng.choice(row)
                out.append({"token": new, "target": t if i in chosen else None})
            rows.append(out)
        return pa.array(rows, kind)

    return run(tokens, key.cast("string"))


def encode_characters(text: Column, vocabulary: DataFrame, limit: int, unknown: int, end: int) -> Column:
    """Codes of a text, cut to ``limit`` with the end code.

    The vocabulary becomes a map: more than ``MAX_SYMBOLS`` symbols (all of
    Unicode has fewer characters assigned to text) raise.
    """
    rows = vocabulary.limit(MAX_SYMBOLS + 1).collect()
    if len(rows) > MAX_SYMBOLS:
        raise ValueError(f"more than {MAX_SYMBOLS} symbols")
    table = F.create_map(*[F.lit(x) for r in rows for x in (r["symbol"], r["code"])])
    symbols = F.slice(F.filter(F.split(text, ""), lambda c: c != ""), 1, limit - 1)
    return F.concat(F.transform(symbols, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(unknown))), F.array(F.lit(end)))


def pad(values: Column, length: int, filler: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), F.greatest(F.lit(0), F.lit(length) - F.size(values))))


def latest_completed(runs: DataFrame, key: list[str], attempt: str = "attempt") -> DataFrame:
    return order.keep_last(runs.filter("status = 'completed'"), key, [attempt])


def missing_runs(grid: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    return grid.join(runs.filter("status = 'completed'").select(*key).distinct(), key, "left_anti")
