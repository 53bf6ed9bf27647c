r"""Phrase collocations by hierarchical pair naming.

Texts become runs of names: words first, then pairs of neighbouring names.  A
name of level k stands for a frequent phrase of k words and is the pair of the
two phrases of k - 1 words that it consists of, the second one word after the
first; so a level is found by counting pairs of neighbouring names of the level
below, and a phrase of k words can only be frequent if both its parts are.
The pair stays in the table of names as the parents of the name: cuts and the
phrases inside a phrase are looked up by following parents, never by comparing
words.

* Texts are read twice, to count words and to name them; then blocks of names
  (positions and 64-bit names, a written table) are all that is read.
* Names are joined globally.  A table of names is sent to the workers only if
  it was counted and has at most ``BROADCAST_NAMES`` rows; beyond that each
  block asks for its distinct keys by a shuffled join, so a hot pair costs one
  row a block.
* Counts are combined in the tasks before they are shuffled.  A task holds at
  most ``HELD`` distinct words at once and hands them on.

Everything is per language: a name belongs to one language, so pairs do too.

Defined results: a null text is empty, a null language ``und``; documents
without words add nothing; repeated rows count each time; ties are broken by
the occurrences and the phrase's bytes; an empty table gives an empty table;
extra columns of any name are passed by.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running_totals, small_batches

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
#: A phrase goes if a longer one has so many percent of its occurrences.
SUBSUMED_PERCENT = 80
#: Names sent to the workers at most (16 bytes each; words about 100 bytes each).
BROADCAST_NAMES = 1_000_000
#: Distinct words that a task holds at once while it counts.
HELD = 300_000
#: Pairs that it holds (16 bytes each), and the rows of one batch that it hands on.
PAIRS_HELD, ROWS_OUT = 1_000_000, 50_000
#: Words after which a block ends with its text: rows of blocks stay small whatever the batches.
BLOCK_WORDS = 8_192

#: Piece ends become a word of their own, tabs blanks.
_BREAK = b"."
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"." * 10 + b" ")


def tokens(text: str) -> list[bytes]:
    """The lower-cased words of a text, with ``_BREAK`` where a piece ends."""
    return text.encode().lower().translate(_TABLE).replace(_BREAK, b" . ").split()


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, word, n`` over all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, counter in held.items():
                counter.pop(_BREAK, None)
                items = iter(counter.items())
                while some := list(islice(items, ROWS_OUT)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(some), pa.string()), pa.array([w for w, _ in some], pa.binary()).cast(pa.string()), pa.array([n for _, n in some], pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text")):
                held.setdefault(name, Counter()).update(tokens(body.as_py()))
            if sum(map(len, held.values())) > HELD:
                yield from flush()
        yield from flush()

    counted = _texts(docs, text, lang).mapInArrow(run, "lang string, word string, n bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def named(counts: DataFrame, key: list[str], min_count: int) -> DataFrame:
    """The rows of ``counts`` with ``n >= min_count``, with dense names from 0 in the order of ``key``."""
    frequent = materialize(counts.filter(F.col("n") >= min_count))
    return materialize(running_totals(frequent, [F.col(c) for c in key], []).withColumnRenamed("before_rank", "name"))


def _block(names: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """Positions and names of one block as two arrays of lists with one list each."""
    kept = names >= 0
    ends = pa.array([0, int(kept.sum())], pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(starts[kept].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(names[kept]))]


_BLOCK = "at array<int>, names array<bigint>"


def _lang_words(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The words of a batch's texts in runs of one language, a break after each text."""
    runs: dict[str, list[bytes]] = {}
    for name, body in zip(batch.column("lang").to_pylist(), batch.column("text")):
        run = runs.setdefault(name, [])
        run += tokens(body.as_py())
        run.append(_BREAK)
        if len(run) > BLOCK_WORDS:
            yield name, runs.pop(name)
    yield from runs.items()


def word_blocks(docs: DataFrame, words: DataFrame, text: str = "text", lang: str = "lang", limit: int = BROADCAST_NAMES) -> DataFrame:
    """Blocks of the names of frequent words: ``at`` (positions; a break leaves a gap) and ``names``."""
    spark = docs.sparkSession
    texts = _texts(docs, text, lang)
    if words.limit(limit + 1).count() <= limit:
        sent = words.select("lang", "word", "name").toArrow()  # at most ``limit`` rows
        tables: dict[str, dict[bytes, int]] = {}
        for name, word, number in zip(sent["lang"].to_pylist(), sent["word"].cast(pa.binary()).to_pylist(), sent["name"].to_pylist()):
            tables.setdefault(name, {})[word] = number
        known = spark.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, words_ in _lang_words(batch):
                    names, at = _compact(words_, known.value.get(name, {}))
                    yield pa.RecordBatch.from_arrays(_block(names, at), ["at", "names"])

        return texts.mapInArrow(run, _BLOCK)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, words_ in _lang_words(batch):
                local: dict[bytes, int] = {}
                for w in words_:
                    if w != _BREAK:
                        local.setdefault(w, len(local))
                codes, at = _compact(words_, local)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([list(local)], pa.list_(pa.binary())).cast(pa.list_(pa.string())), *_block(codes, at)], ["lang", "keys", "at", "names"])

    blocks = materialize(texts.mapInArrow(split, f"lang string, keys array<string>, {_BLOCK}").withColumn("block", F.monotonically_increasing_id()))
    asked = blocks.select("block", "lang", F.posexplode("keys").alias("code", "word"))
    return _answered(blocks, asked.join(words.select("lang", "word", "name"), ["lang", "word"]))


def _compact(words: list[bytes], table: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words (-1: none, breaks too) and their positions."""
    return np.fromiter(map(table.get, words, repeat(-1)), np.int64, len(words)), np.arange(len(words))


def _answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with local codes replaced by the names that the join gave (``block, code, name``)."""
    per = answers.groupBy("block").agg(F.collect_list("code").alias("codes"), F.collect_list("name").alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, local = (np.asarray(batch.column(c)[i].values) for c in ("at", "names"))
                table = np.full(int(local.max()) + 1 if len(local) else 0, -1, np.int64)
                codes, found = batch.column("codes")[i], batch.column("found")[i]
                if codes.is_valid:
                    table[np.asarray(codes.values)] = np.asarray(found.values)
                yield pa.RecordBatch.from_arrays(_block(table[local], at), ["at", "names"])

    return blocks.select("block", "at", "names").join(per, "block", "left").drop("block").mapInArrow(run, _BLOCK)


def _pairs(at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of neighbouring names, and both names."""
    joined = np.nonzero(at[1:] == at[:-1] + 1)[0]
    return at[joined], names[joined], names[joined + 1]


def _place(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values in a sorted table, -1 for those it lacks."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    place = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[place] == values, place, -1)


def _lookup_table(left: np.ndarray, right: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, ...]:
    """A table of pairs for ``_looked_up``: each side's distinct names, the pairs' codes in order, and their names."""
    lefts, i = np.unique(left, return_inverse=True)
    rights, j = np.unique(right, return_inverse=True)
    packed = i * max(len(rights), 1) + j
    order = np.argsort(packed)
    return lefts, rights, packed[order], names[order]


def _looked_up(table: tuple[np.ndarray, ...], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of the pairs, -1 for those the table lacks."""
    lefts, rights, packed, names = table
    i, j = _place(lefts, left), _place(rights, right)
    place = _place(packed, np.where((i >= 0) & (j >= 0), i * max(len(rights), 1) + j, -1))
    return np.where(place >= 0, names[place], -1) if len(names) else np.full(len(left), -1, np.int64)


def _distinct(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the pair's number of each row."""
    order = np.lexsort((right, left))
    l, r = left[order], right[order]  # noqa: E741
    new = np.ones(len(order), bool)
    new[1:] = (l[1:] != l[:-1]) | (r[1:] != r[:-1])
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.cumsum(new) - 1
    return l[new], r[new], numbers


def _counted(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, and how often each occurs."""
    width = int(right.max()) + 1 if len(right) else 1
    if len(left) and int(left.max()) < (1 << 62) // width:
        packed, n = np.unique(left * width + right, return_counts=True)
        return packed // width, packed % width, n.astype(np.int64)
    lefts, rights, numbers = _distinct(left, right)
    return lefts, rights, np.bincount(numbers, minlength=len(lefts)).astype(np.int64)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``left, right, n`` of neighbouring names over all blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                left, right, n = _counted(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                for at in range(0, len(left), ROWS_OUT):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + ROWS_OUT]) for x in (left, right, n)], ["left", "right", "n"])
            held.clear()

        for batch in batches:
            for at, names in zip(batch.column("at"), batch.column("names")):
                _, left, right = _pairs(np.asarray(at.values), np.asarray(names.values))
                held.append((left, right))
                size += len(left)
                if size > PAIRS_HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return blocks.mapInArrow(run, "left bigint, right bigint, n bigint").groupBy("left", "right").agg(F.sum("n").alias("n"))


def pair_blocks(blocks: DataFrame, pairs: DataFrame, limit: int = BROADCAST_NAMES) -> DataFrame:
    """Blocks one level up: neighbouring names replaced by the name of their pair, the others dropped."""
    if pairs.limit(limit + 1).count() <= limit:
        sent = pairs.select("left", "right", "name").toArrow()  # at most ``limit`` rows
        known = blocks.sparkSession.sparkContext.broadcast(_lookup_table(*(sent[c].to_numpy() for c in ("left", "right", "name"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = known.value
            for batch in batches:
                for at, names in zip(batch.column("at"), batch.column("names")):
                    starts, left, right = _pairs(np.asarray(at.values), np.asarray(names.values))
                    yield pa.RecordBatch.from_arrays(_block(_looked_up(table, left, right), starts), ["at", "names"])

        return blocks.mapInArrow(run, _BLOCK)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, names in zip(batch.column("at"), batch.column("names")):
                starts, left, right = _pairs(np.asarray(at.values), np.asarray(names.values))
                lefts, rights, codes = _distinct(left, right)
                yield pa.RecordBatch.from_arrays([pa.array([lefts], pa.list_(pa.int64())), pa.array([rights], pa.list_(pa.int64())), *_block(codes, starts)], ["lefts", "rights", "at", "names"])

    split_blocks = materialize(blocks.mapInArrow(split, f"lefts array<bigint>, rights array<bigint>, {_BLOCK}").withColumn("block", F.monotonically_increasing_id()))
    asked = split_blocks.select("block", F.posexplode(F.arrays_zip("lefts", "rights")).alias("code", "pair")).select("block", "code", F.col("pair.lefts").alias("left"), F.col("pair.rights").alias("right"))
    return _answered(split_blocks, asked.join(pairs.select("left", "right", "name"), ["left", "right"]))


def phrase_tables(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, words: int = MAX_WORDS, limit: int = BROADCAST_NAMES) -> tuple[DataFrame, list[DataFrame]]:
    """The words of each language (``lang, n``) and the names of levels 1 to ``words``.

    Level 1: ``lang, word, n, name``; the others ``left, right, n, name`` with the parents' names.
    """
    small_batches(docs.sparkSession)
    counts = materialize(word_counts(docs, text, lang))
    totals = materialize(counts.groupBy("lang").agg(F.sum("n").alias("n")))
    levels = [named(counts, ["lang", "word"], min_count)]
    blocks = materialize(word_blocks(docs, levels[0], text, lang, limit))
    for k in range(2, words + 1):
        levels.append(named(pair_counts(blocks), ["left", "right"], min_count))
        if k < words:
            blocks = materialize(pair_blocks(blocks, levels[-1], limit))
    return totals, levels


def _floor_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)) in whole numbers wider than 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    product = (wide(a) * F.lit(2_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    total = (wide(l) + wide(r)).cast("decimal(38,0)")
    rest = product % total
    return ((product - rest) / total).cast("decimal(38,0)").cast("long")


def candidates(levels: list[DataFrame]) -> DataFrame:
    """All frequent phrases of two words and more that no longer one subsumes: ``lang, phrase, a, l, r, score``.

    ``firsts`` and ``lasts`` of a name are the occurrences of its first and last
    1, 2, ... words, so its parents' lists give every cut.  Only the direct
    children of a phrase can subsume it: a longer phrase around it contains one
    that is as frequent.
    """
    below = levels[0].select(
        "name", "lang", F.col("word").alias("phrase"), F.col("word").alias("tail"), F.col("n").alias("a"), F.array("n").alias("firsts"), F.array("n").alias("lasts"))
    out, known = [], []
    for level in levels[1:]:
        l = below.select(F.col("name").alias("left"), "lang", F.col("phrase").alias("_head"), F.col("firsts").alias("_firsts"))  # noqa: E741
        r = below.select(F.col("name").alias("right"), "tail", F.col("lasts").alias("_lasts"))
        below = materialize(level.join(l, "left").join(r, "right").select(
            "name", "left", "right", "lang", F.concat("_head", F.lit(" "), "tail").alias("phrase"), "tail", F.col("n").alias("a"),
            F.concat("_firsts", F.array("n")).alias("firsts"), F.concat("_lasts", F.array("n")).alias("lasts"), "_firsts", "_lasts"))
        known.append(below)
    for k, here in enumerate(known, 2):
        # the cut after c words: the first c words, and the last k - c
        cuts = [F.struct(_floor_score(F.col("a"), F.col("_firsts")[c - 1], F.col("_lasts")[k - c - 1]).alias("score"), F.lit(c).alias("k"),
                         F.col("_firsts")[c - 1].alias("l"), F.col("_lasts")[k - c - 1].alias("r")) for c in range(1, k)]
        rows = here.select("name", "lang", "phrase", "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut"))
        if k - 1 < len(known):
            above = known[k - 1]
            longest = above.select(F.col("left").alias("name"), F.col("a").alias("longer")).unionByName(above.select(F.col("right").alias("name"), F.col("a").alias("longer")))
            longest = longest.groupBy("name").agg(F.max("longer").alias("longer"))
            wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
            rows = rows.join(longest, "name", "left").filter(F.col("longer").isNull() | (wide("longer", 100) < wide("a", SUBSUMED_PERCENT)))
        out.append(rows.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    return reduce(DataFrame.unionByName, out)


def collocation_rows(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, limit: int = BROADCAST_NAMES) -> DataFrame:
    """The contract's columns: each language's first ``top`` phrases."""
    totals, levels = phrase_tables(docs, text, lang, min_count, limit=limit)
    found = candidates(levels)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # cut in the map tasks already
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
