"""Vocabularies, contexts, co-occurrence lexicons and word alignment."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: Targets that are looked for inside the rows; more of them by a bit map, then by a join.
FEW_TARGETS = 200
#: Bits of the map that stands for more of them; words of texts whose neighbours are counted together, rows
#: taken at a time, and neighbours summed in one task.
LISTED_BITS, NEAR_WORDS, NEAR_ROWS, NEAR_PAIRS = 1 << 26, 1 << 20, 64, 1_000_000


def term_counts(df: DataFrame, words: Column) -> DataFrame:
    return df.select(F.explode(words).alias("token")).groupBy("token").count()


def vocabulary(df: DataFrame, text: Column) -> DataFrame:
    """Distinct words without plain numbers, sorted."""
    words = df.select(F.explode(T.tokens(text, "vocabulary")).alias("token")).distinct()
    return words.filter(~F.col("token").rlike("^\\p{Nd}+$")).orderBy("token")


def capitalized(df: DataFrame, text: Column, min_count: int = 3, min_ratio: float = 0.6, skip_first: bool = False) -> DataFrame:
    """Probable names: tokens that are mostly written with a capital."""
    words = df.select(F.posexplode(F.regexp_extract_all(T.blank(text), F.lit(T.TOKENIZERS["alpha"]), F.lit(1))).alias("at", "surface"))
    if skip_first:
        words = words.filter("at > 0")
    counted = words.groupBy(T.casefold(F.col("surface")).alias("token")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("surface").rlike("^\\p{Lu}")).alias("capitals"))
    return counted.filter((F.col("total") >= min_count) & (F.col("capitals") / F.col("total") >= min_ratio))


def _listed(targets: DataFrame) -> np.ndarray:
    """A bit map of the targets' hashes; its size does not depend on their number."""
    place = T.token_hash(F.col("token")).bitwiseAND(F.lit(LISTED_BITS - 1)) + 1
    found = targets.filter("token is not null").groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(LISTED_BITS // 8, np.uint8)
    for b, bits in found.collect():
        out[(b - 1) * len(bits) : b * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _near_words(words: pa.Array, listed: np.ndarray, window: int) -> pa.RecordBatch:
    """(token, near, n): the neighbours of each word whose bit is set, and how often each is one."""
    sizes = np.diff(np.asarray(words.offsets))
    coded = words.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    place = np.array([zlib.crc32(w.encode()) & (LISTED_BITS - 1) for w in names.to_pylist()], np.int64)
    at = np.nonzero((listed[place >> 3] >> (place & 7).astype(np.uint8) & 1)[codes])[0] if len(codes) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    pairs = [np.zeros(0, np.int64)]
    for shift in (*range(-window, 0), *range(1, window + 1)):
        mine = at[(at + shift >= 0) & (at + shift < len(row))]
        mine = mine[row[mine] == row[mine + shift]]
        pairs.append(codes[mine] * len(names) + codes[mine + shift])
    pair, n = np.unique(np.concatenate(pairs), return_counts=True)
    token, near = np.divmod(pair, max(len(names), 1))
    starts = np.nonzero(np.diff(token, prepend=-1))[0]
    cuts = pa.array(np.append(starts, len(token)), pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(cuts, names.take(pa.array(near))), "\n")
    return pa.record_batch([names.take(pa.array(token[starts])), joined, pa.ListArray.from_arrays(cuts, pa.array(n, pa.int32()))], ["token", "near", "n"])


def _grouped_near(df: DataFrame, words: Column, targets: DataFrame, window: int) -> DataFrame:
    """(token, near, n) of the texts: a row a token and ``NEAR_WORDS`` words of the texts, for the
    targets and a few other tokens whose bits are theirs."""
    shared = df.sparkSession.sparkContext.broadcast(_listed(targets))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            lists = batch.column(0).drop_null()
            for i in range(0, len(lists), NEAR_ROWS):
                part = pa.concat_arrays([lists[i : i + NEAR_ROWS]])
                held.append(part)
                size += len(part.flatten())
                if size >= NEAR_WORDS:
                    yield _near_words(pa.concat_arrays(held), shared.value, window)
                    held, size = [], 0
        if held:
            yield _near_words(pa.concat_arrays(held), shared.value, window)

    return df.select(words.alias("w")).mapInArrow(run, "token string, near string, n array<int>")


def near_tasks(counted: DataFrame, window: int = 2) -> int:
    """Partitions in which the neighbours of tokens (with ``count``) are summed without spilling."""
    n = counted.agg(F.sum("count")).first()[0] or 0
    return max(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * window * n // NEAR_PAIRS))


def contexts(df: DataFrame, words: Column, targets: DataFrame, window: int = 2, top: int = 50, fold: bool = True, tasks: int | None = None) -> DataFrame:
    """(token, context, count): neighbours within ``window`` of the target tokens.

    Neighbours are taken inside the row, so no self join is made; of many targets
    they are counted where the texts stand, and only rows of targets are shuffled,
    once and by token, to ``tasks`` partitions (``near_tasks``).  Words hold no line breaks.
    """
    wanted = targets.select("token").distinct()
    named = [r[0] for r in wanted.limit(FEW_TARGETS + 1).collect()]
    if len(named) <= FEW_TARGETS:
        # windows are cut inside the row, so an exploded row does not carry the whole text
        w = F.col("w")

        def around(token: Column, i: Column) -> Column:
            before = F.when(i > 0, F.slice(w, F.greatest(i + 1 - window, F.lit(1)), F.least(i, F.lit(window)))).otherwise(F.array().cast("array<string>"))
            return F.struct(token.alias("token"), F.concat(before, F.slice(w, i + 2, window)).alias("near"))

        places = F.filter(F.transform("w", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin(named))
        each = df.select(words.alias("w")).select(F.explode(F.transform(places, lambda x: around(x["t"], x["i"]))).alias("x")).select("x.token", "x.near")
        hits = each.select("token", F.explode("near").alias("context")).withColumn("n", F.lit(1))
    else:
        grouped = _grouped_near(df, words, wanted, window)
        # both sides are dealt alike, else the number of tasks is lost; a semi join would be
        # moved below the repartition and shuffle the texts' side twice
        dealt = lambda x: x.repartition(tasks, "token") if tasks else x.repartition("token")
        grouped = dealt(grouped).join(dealt(targets.select("token")).distinct(), "token")
        hits = grouped.select("token", F.split("near", "\n").alias("context"), "n").select("token", F.inline(F.arrays_zip("context", "n")))
    if fold:
        hits = hits.withColumn("context", T.signature(F.col("context"), None))
    counted = hits.groupBy("token", "context").agg(F.sum("n").alias("count"))
    ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("count"), "context")))
    return ranked.filter(F.col("_r") <= top).drop("_r")


def weighted_jaccard(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, similarity) of bags (key, context, count): sum of minima over sum of maxima.

    Only keys that share a context meet; maxima follow from the totals.
    """
    lt = left.groupBy("token").agg(F.sum("count").alias("_lt")).withColumnRenamed("token", a)
    rt = right.groupBy("token").agg(F.sum("count").alias("_rt")).withColumnRenamed("token", b)
    shared = left.select(F.col("token").alias(a), "context", F.col("count").alias("_l")).join(right.select(F.col("token").alias(b), "context", F.col("count").alias("_r")), "context")
    mins = shared.groupBy(a, b).agg(F.sum(F.least("_l", "_r")).alias("_m"))
    return mins.join(lt, a).join(rt, b).select(a, b, (F.col("_m") / (F.col("_lt") + F.col("_rt") - F.col("_m"))).alias("similarity"))


def cooccurrence_lexicon(pairs: DataFrame, source: Column, target: Column, min_count: int = 1, min_p: float = 0.0) -> DataFrame:
    """(src, tgt, count, p): distinct tokens of a pair co-occur once; p is over
    all of a source's counts, before the filters."""
    both = pairs.select(F.array_distinct(source).alias("s"), F.array_distinct(target).alias("t"))
    each = both.select(F.explode("s").alias("src"), "t").select("src", F.explode("t").alias("tgt"))
    counted = each.groupBy("src", "tgt").count()
    total = counted.groupBy("src").agg(F.sum("count").alias("_all"))
    out = counted.join(total, "src").withColumn("p", F.col("count") / F.col("_all")).drop("_all")
    return out.filter((F.col("count") >= min_count) & (F.col("p") >= min_p))


def reverse_lexicon(lexicon: DataFrame) -> DataFrame:
    """Best source of each target; ties: higher p, then the smaller word."""
    return best_translation(lexicon.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "p"))


def best_translation(lexicon: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("tgt", "p"), F.struct((-F.col("p")).alias("p"), F.col("tgt").alias("tgt")))
    return lexicon.groupBy("src").agg(best.alias("_b")).select("src", "_b.tgt", "_b.p")


def top_translations(lexicon: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("p"), "tgt"))
    return lexicon.withColumn("rank", rank).filter(F.col("rank") <= k)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared sources, and the share whose best translation agrees."""
    x = best_translation(a).select("src", F.col("tgt").alias("_x"))
    y = best_translation(b).select("src", F.col("tgt").alias("_y"))
    joined = x.join(y, "src").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("_x") == F.col("_y")).alias("equal"))
    return joined.withColumn("rate", F.when(F.col("shared") == 0, F.lit(0.0)).otherwise(F.col("equal") / F.col("shared")))


#: Cells of a block, which one task holds, and of a slot, into which a frequent target word is split.
BLOCK, SLOT = 250_000, 50_000


def _expected(cells: pa.Table, table: pa.Table | None) -> pa.Table:
    """A block's expected counts (block, src, tgt, c) under its part of the translation table (None: uniform)."""
    coded = {c: cells.column(c).combine_chunks().dictionary_encode() for c in ("k", "src", "tgt")}
    at = {c: x.indices.to_numpy().astype(np.int64) for c, x in coded.items()}
    width = len(coded["tgt"].dictionary)
    kinds, kind = np.unique(at["src"] * width + at["tgt"], return_inverse=True)
    _, sums = np.unique(at["k"] * width + at["tgt"], return_inverse=True)
    p = np.ones(len(kinds))
    if table is not None:
        mine = [pc.index_in(table.column(c), value_set=coded[c].dictionary).to_numpy().astype(np.int64) for c in ("src", "tgt")]
        p[np.searchsorted(kinds, mine[0] * width + mine[1])] = table.column("p").to_numpy()
    weight = cells.column("ns").to_numpy() * p[kind]
    norm = np.bincount(sums, weight)
    counts = np.bincount(kind, cells.column("nt").to_numpy() * weight / norm[sums], len(kinds))
    block = pa.array(np.full(len(kinds), cells.column("block")[0].as_py()), pa.int64())
    return pa.table({"block": block, "src": coded["src"].dictionary.take(pa.array(kinds // width)), "tgt": coded["tgt"].dictionary.take(pa.array(kinds % width)), "c": counts})


def _first(cells: pa.Table) -> pa.Table:
    return _expected(cells, None)


def ibm1(pairs: DataFrame, key: str, source: Column, target: Column, rounds: int = 5, checkpoint=None) -> DataFrame:
    """IBM model 1 by EM in blocks: (src, tgt, p); null words are left out.

    The co-occurrence cells are written once, bucketed by blocks of target words,
    and are never shuffled again: a pair's norm for a target word needs that word's
    cells only.  A frequent word is split by pairs into slots, so the counts of
    (src, tgt) are summed in two levels, first in the blocks.  A round shuffles a row
    for each (src, tgt) of a block, however often the two meet.  ``checkpoint`` cuts
    the lineage (default: a written table, which survives lost executors).
    """
    from ..sources.shared import cut, few, scratch

    checkpoint, spark = checkpoint or cut, pairs.sparkSession
    sides = pairs.select(F.col(key).alias("k"), F.concat(F.array(F.lit("")), source).alias("s"), target.alias("t"))
    src = sides.select("k", F.explode("s").alias("src")).filter("src is not null").groupBy("k", "src").agg(F.count(F.lit(1)).alias("ns"))
    tgt = sides.select("k", F.explode("t").alias("tgt")).filter("tgt is not null").groupBy("k", "tgt").agg(F.count(F.lit(1)).alias("nt"))
    # cells of a target word, counted before they are made
    widths = tgt.join(src.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k").groupBy("tgt").agg(F.sum("n").alias("n"))
    widths = checkpoint(widths)
    total = widths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = min(max(1, -(-total // BLOCK)), 100_000)
    # at most total / SLOT words are split
    slots = widths.filter(F.col("n") > SLOT).select("tgt", F.ceil(F.col("n") / SLOT).alias("slots"))
    placed = tgt.join(few(slots), "tgt", "left").withColumn("slot", F.pmod(F.xxhash64("k"), F.coalesce("slots", F.lit(1))))
    cells = src.join(placed, "k").select("k", "src", "ns", "tgt", "nt", F.pmod(F.xxhash64("tgt", "slot"), F.lit(blocks)).alias("block"))
    name = f"cells_{uuid.uuid4().hex}"
    cells.repartition(blocks, "block").write.option("path", f"{scratch(spark, 'cells')}/blocks").bucketBy(blocks, "block").saveAsTable(name)
    schema = "block long, src string, tgt string, c double"
    try:
        counts = checkpoint(spark.table(name).groupBy("block").applyInArrow(_first, schema))
        for i in range(rounds):
            summed = counts.groupBy("src", "tgt").agg(F.sum("c").alias("c"))
            totals = summed.groupBy("src").agg(F.sum("c").alias("_c"))
            table = checkpoint(summed.join(totals, "src").select("src", "tgt", (F.col("c") / F.col("_c")).alias("p")))
            if i + 1 < rounds:
                mine = counts.select("block", "src", "tgt").join(table, ["src", "tgt"])
                counts = checkpoint(spark.table(name).groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_expected, schema))
    finally:
        spark.sql(f"DROP TABLE {name}")
    return table


def align_best(pairs: DataFrame, key: str, source: Column, target: Column, table: DataFrame) -> DataFrame:
    """Best source position of every target token under a translation table (null: unaligned)."""
    s = pairs.select(F.col(key).alias("k"), F.posexplode(source).alias("i", "src"))
    t = pairs.select(F.col(key).alias("k"), F.posexplode(target).alias("j", "tgt"))
    scored = t.join(s, "k").join(table, ["src", "tgt"])
    empty = t.join(table.filter("src = ''").select("tgt", "p"), "tgt", "left").select("k", "j", "tgt", F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("src"), F.coalesce("p", F.lit(0.0)).alias("p"))
    every = scored.select("k", "j", "tgt", "i", "src", "p").unionByName(empty)
    best = F.min_by(F.struct("i", "src", "p"), F.struct((-F.col("p")).alias("p"), F.coalesce("i", F.lit(-1)).alias("i")))
    return every.groupBy("k", "j", "tgt").agg(best.alias("_b")).select(F.col("k").alias(key), "j", "tgt", "_b.i", "_b.src", "_b.p")


def ngram_counts(df: DataFrame, words: Column, largest: int = 2, min_chars: int = 3) -> DataFrame:
    grams = df.select(F.explode(T.ngrams(words, largest)).alias("ngram")).filter(F.length("ngram") >= min_chars)
    return grams.groupBy("ngram").count()


def character_vocabulary(df: DataFrame, text: Column, specials: list[str]) -> DataFrame:
    """(symbol, code): specials first, then the distinct code points in order."""
    points = df.select(F.explode(F.filter(F.split(T.blank(text), ""), lambda c: c != "")).alias("symbol")).distinct()
    numbered = points.select("symbol", (F.row_number().over(Window.orderBy("symbol")) - 1 + len(specials)).alias("code"))
    fixed = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(specials)], "symbol string, code int")
    return fixed.unionByName(numbered)
