"""Top-k set overlap between two tables, and scores of the pairs found, in cells.

Both tables are cut into blocks and every cell (a block of tokens, a block of
words) is one task's work of bounded size, so that no row is made for a pair of
sets that merely share an element.  Inside a cell an element's posting list
holds the words of the block that have it; a token reads its lists from the
shortest on, and once the k-th best overlap exceeds the number of lists that are
left, no unseen word can enter, so the long lists are only asked for the words
already seen.  What leaves a cell are the best k words of each token.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a block, tokens of a block at most, and tokens that are worth a task of their own.
WORD_BLOCK, TOKEN_BLOCK, TOKEN_TASK = 50_000, 20_000, 500


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    parts = [c for c in column.chunks if len(c)]
    sizes = np.concatenate([np.diff(np.asarray(c.offsets)) for c in parts]) if parts else np.zeros(0, np.int64)
    values = np.concatenate([np.asarray(c.flatten()) for c in parts]) if parts else np.zeros(0, np.int64)
    return values, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _largest(counts: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest positive counts, larger first, then in order of place."""
    places = np.nonzero(counts)[0]
    found = counts[places]
    if len(places) > k:
        above = np.cumsum(np.bincount(found)[::-1])[::-1]  # how many have at least so much
        least = int(np.nonzero(above >= k)[0][-1])
        room = k - int(above[least + 1] if least + 1 < len(above) else 0)
        chosen = np.concatenate([places[found > least], places[found == least][:room]])
        places = np.sort(chosen)
        found = counts[places]
    return places[np.argsort(-found, kind="stable")]


def best_overlaps(postings: list[np.ndarray], words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` words (places in the block) in most of the posting lists, and in how many they are.

    Ties go to the smaller place; words in no list are left out.
    """
    counts = np.zeros(words, np.int64)
    lists = sorted(postings, key=len)
    seen: np.ndarray | None = None
    touched = 0
    for i, p in enumerate(lists):
        if seen is None:
            counts[p] += 1
            touched += len(p)
            left = len(lists) - i - 1
            if left and touched >= k and int(np.count_nonzero(counts > left)) >= k:
                seen = np.nonzero(counts)[0]
        elif len(p):
            at = np.minimum(np.searchsorted(p, seen), len(p) - 1)
            counts[seen] += p[at] == seen
    best = _largest(counts, k)
    return best, counts[best]


def _blocks(tokens: DataFrame, words: DataFrame) -> tuple[int, int]:
    """Numbers of token and word blocks."""
    spark = tokens.sparkSession
    n, m = tokens.count(), words.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-n // TOKEN_BLOCK), min(-(-n // TOKEN_TASK), tasks), 1), max(-(-m // WORD_BLOCK), 1)


def cells(tokens: DataFrame, words: DataFrame, blocks: tuple[int, int], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, of: Column | None = None) -> DataFrame:
    """``work`` on each cell's rows of ``tokens`` (with ``token``) and ``words`` (with a dense ``wid``).

    ``of``: the word blocks (an array) that a token needs; without it, all.
    """
    wide, high = blocks
    needs = F.sequence(F.lit(0), F.lit(high - 1)) if of is None else of
    t = tokens.withColumn("tb", F.pmod(F.xxhash64("token"), F.lit(wide)).cast("int")).withColumn("wb", F.explode(needs))
    w = words.withColumn("wb", F.floor(F.col("wid") / WORD_BLOCK).cast("int")).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    return t.groupBy("tb", "wb").cogroup(w.groupBy("tb", "wb")).applyInArrow(lambda a, b: work(a, b), schema)


def _texts(table: pa.Table, names: tuple[str, ...]) -> dict[str, pa.ChunkedArray]:
    return {c: table[c].cast(pa.string()) if pa.types.is_large_string(table[c].type) else table[c] for c in names}


def top_overlaps(tokens: DataFrame, words: DataFrame, k: int, gap: int) -> DataFrame:
    """(token, near): of the ``k`` words that share most elements (ties by ``wid``), the
    ``wid`` of those whose size differs by at most ``gap``, best first.

    ``tokens``: token, elements (array<bigint>, distinct), size; ``words``: wid
    (dense from 0, in the order of ties), elements, size.  Between the cells a word
    is one number: minus the elements shared, its wid, and a bit for the gap.
    """
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("wid")
        values, offsets = _lists(right["elements"])
        owner = np.repeat(np.arange(right.num_rows), np.diff(offsets))
        by = np.argsort(values, kind="stable")
        names, starts = np.unique(values[by], return_index=True)
        ends = np.append(starts[1:], len(by))
        owner = owner[by]
        wid, size = right["wid"].to_numpy(), right["size"].to_numpy()
        asked, bounds = _lists(left["elements"])
        place = np.minimum(np.searchsorted(names, asked), max(len(names) - 1, 0))
        known = names[place] == asked if len(names) else np.zeros(len(asked), bool)
        near = left["size"].to_numpy()
        out = []
        for i in range(left.num_rows):
            mine = place[bounds[i] : bounds[i + 1]][known[bounds[i] : bounds[i + 1]]]
            best, shared = best_overlaps([owner[starts[j] : ends[j]] for j in mine], right.num_rows, k)
            out.append(shared * -(1 << 33) + wid[best].astype(np.int64) * 2 + (np.abs(size[best] - near[i]) <= gap))
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        best = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *out]), pa.int64()))
        return pa.table(_texts(left, ("token",)) | {"best": best})

    blocks = _blocks(tokens, words)
    found = cells(tokens, words, blocks, work, "token string, best array<bigint>")
    if blocks[1] > 1:
        # at most k of each word block meet
        found = found.groupBy("token").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    fits = F.filter("best", lambda b: b.bitwiseAND(F.lit(1)) == 1)
    return found.select("token", F.transform(fits, lambda b: F.shiftright(b, 1).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("near"))


def bag_scores(tokens: DataFrame, words: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(token, carried columns, found): for each candidate of a token an array of (word, form, similarity), the
    weighted Jaccard of their bags; a row for each token and word block with candidates.

    ``tokens``: token, candidates (array of wid), keys and counts (the bag, sorted
    by key); ``words``: wid, word, form, keys, counts.
    """
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("wid")
        wid = right["wid"].to_numpy()
        keys, offsets = _lists(right["keys"])
        counts, _ = _lists(right["counts"])
        totals = np.add.reduceat(np.append(counts, 0), offsets[:-1]) * (np.diff(offsets) > 0) if right.num_rows else np.zeros(0)
        names, forms = (c.combine_chunks() for c in _texts(right, ("word", "form")).values())
        own_keys, bounds = _lists(left["keys"])
        own_counts, _ = _lists(left["counts"])
        wanted, cuts = _lists(left["candidates"])
        places, similarities = [], []
        for i in range(left.num_rows):
            mine = wanted[cuts[i] : cuts[i + 1]]
            mine = mine[mine // WORD_BLOCK == wid[0] // WORD_BLOCK] if len(wid) else mine[:0]
            c = np.searchsorted(wid, mine)
            k, n = own_keys[bounds[i] : bounds[i + 1]], own_counts[bounds[i] : bounds[i + 1]]
            length = offsets[c + 1] - offsets[c]
            at = np.repeat(offsets[c] - np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64), length) + np.arange(int(length.sum())) if len(c) else np.zeros(0, np.int64)
            least = np.zeros(len(c))
            if len(k) and len(at):
                p = np.minimum(np.searchsorted(k, keys[at]), len(k) - 1)
                least = np.bincount(np.repeat(np.arange(len(c)), length), np.where(k[p] == keys[at], np.minimum(n[p], counts[at]), 0), len(c))
            similarity = least / np.maximum(n.sum() + totals[c] - least, 1)
            places.append(c)
            similarities.append(similarity)
        cuts, at = np.concatenate([[0], np.cumsum([len(c) for c in places])]), pa.array(np.concatenate([np.zeros(0, np.int64), *places]))
        parts = [names.take(at), forms.take(at), pa.array(np.concatenate([np.zeros(0), *similarities]))]
        found = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(parts, ["word", "form", "similarity"]))
        return pa.table(_texts(left, ("token", *carried)) | {"found": found})

    kept = "".join(f"{c} {kind}, " for c, kind in tokens.select("token", *carried).dtypes)
    needed = F.array_distinct(F.transform("candidates", lambda w: F.floor(w / WORD_BLOCK).cast("int")))
    return cells(tokens, words, _blocks(tokens, words), work, kept + "found array<struct<word:string,form:string,similarity:double>>", needed)
