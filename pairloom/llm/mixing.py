"""Mixing sources to target weights, with DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share ``budget`` times all words.  A target stops at ``max_passes`` times its
source's words and the excess is shared again by weight: the fixed point is
``min(cap, level * weight)`` with one level for all, found from two running
sums over the sources.

Draws: a keyed digest of the id permutes the documents of a source; leading
hex digits of the digest cut the permutation into blocks.  A source takes all
its blocks once for every whole pass and, for the rest, the leading blocks of
one more pass up to its target; inside the last block the cut falls at the
document nearest to the target.

Splitting tree: the drawn blocks are the balls and their sources the colours.
At every node, a keyed permutation of the node's blocks sends one half left
and one half right, so the colours of a half are a multivariate
hypergeometric draw and the quotas of both halves add up exactly.  After
``levels`` splits the leaves are ``2**levels`` output shards with disjoint
blocks; rows are shuffled inside a shard by a keyed digest.

Bounds: a block is one row, and there are ``MAX_BLOCKS`` or one a source.
Sources are ranked and summed by range partitions, and a node's blocks are
ranked by the leading digits of their marks first (``RANK_DIGITS``, so a task
counts at most 4,096 rows a node) and then inside equal digits, so no task
sees all blocks or sources.  Windows over documents are cut by (source, last
block).  Tables of sources and blocks meet the documents by broadcast if
counted as few, else by salted joins.

Defined results: a null or empty text has size 0 and is never taken; a null
source is the last source; a null id permutes like the empty id; rows with the
same source and id are taken together; an empty table gives an empty table.
Reruns and other partitionings give the same draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, materialize, running_totals, size_checked, small_batches, word_count

WEIGHTS = (5, 2, 1)
SEED = "mix-1"
#: Aimed-at documents of a block, and most blocks of all sources together.
BLOCK_DOCS, MAX_BLOCKS = 512, 65_536
#: Hex digits of a mark that are counted before the exact rank is taken.
RANK_DIGITS = 3


def _name(source: str) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _key(id_col: str, source: str, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), _name(source), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def source_targets(sized: DataFrame, budget: float = 1.5, max_passes: int = 2) -> DataFrame:
    """One row a source: name, source, docs, words, weight, target, passes, rest.

    ``sized`` has source and size.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).withColumn("name", _name("source"))
    by_name = [F.col("source").asc_nulls_last()]
    per = running_totals(per, by_name, []).withColumn("cap", F.col("words") * max_passes)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("before_rank"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = per.withColumn("weight", weight).drop("before_rank")
    ratio = F.col("cap") / F.col("weight")
    ranked = materialize(running_totals(per.withColumn("ratio", ratio), [F.col("ratio").asc(), *by_name], ["cap", "weight"]))
    total = ranked.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    # the first source, by ratio, that the level leaves below its cap fixes the level of all
    level = (F.lit(float(budget)) * F.lit(total["words"]) - F.col("before_cap")) / (F.lit(total["weight"]) - F.col("before_weight"))
    fits = ranked.withColumn("_level", level).filter(F.col("_level") * F.col("weight") <= F.col("cap"))
    found = fits.agg(F.min(F.struct("ratio", F.col("source").isNull().alias("last"), "source", F.col("_level").alias("level"))).alias("f")).first()["f"]
    cap = F.col("cap").cast("double")
    out = ranked.withColumn("target", cap if found is None else F.least(cap, F.lit(found["level"]) * F.col("weight")))
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int")
    return out.withColumn("passes", passes).select(
        "name", "source", "docs", "words", "weight", "target", "passes", (F.col("target") - F.col("passes") * F.col("words")).alias("rest"))


def block_digits(docs: Column, total: int) -> Column:
    """Hex digits of the digest that number a source's blocks.

    Each source has its own number, so a hot source has more blocks, not larger
    ones.  Blocks are aimed at ``BLOCK_DOCS`` documents or more, as many as
    keeps all sources' blocks within ``MAX_BLOCKS``.
    """
    aim = max(BLOCK_DOCS, -(-total * 16 // MAX_BLOCKS))
    return sum(((docs > aim * 16**k).cast("int") for k in range(1, 8)), (docs > aim).cast("int"))


class Plan:
    """What a mix takes: ``sources`` (one row each) and ``blocks`` (bounded)."""

    def __init__(self, sources: DataFrame, blocks: DataFrame, seed: str):
        self.sources, self.blocks, self.seed = sources, blocks, seed


def _blocks(docs: DataFrame, sources: DataFrame, id_col: str, source: str, seed: str) -> DataFrame:
    """``docs`` plus ``_name``, ``_k``, the place in the source's permutation, and ``_block``, its leading digits."""
    keyed = docs.withColumns({"_name": _name(source), "_k": _key(id_col, source, seed)})
    joined = lookup(keyed, sources.select(F.col("name").alias("_name"), F.col("digits").alias("_d")), "_name", F.col("_k"))
    return joined.withColumn("_block", F.substring(F.col("_k"), F.lit(1), F.col("_d"))).drop("_d")


def plan_mix(sized: DataFrame, levels: int = 4, budget: float = 1.5, max_passes: int = 2, seed: str = SEED) -> Plan:
    """Plan from ``sized`` (doc_id, source, size): targets, cuts, and the tree."""
    sources = source_targets(sized, budget, max_passes)
    total = sources.agg(F.sum("docs")).first()[0] or 0
    sources = materialize(sources.withColumn("digits", block_digits(F.col("docs"), total)))
    keyed = _blocks(sized, sources, "doc_id", "source", seed).select(F.col("_name").alias("name"), F.col("_block").alias("block"), "_k", "size")
    blocks = materialize(keyed.groupBy("name", "block").agg(F.sum("size").alias("block_words"), F.count(F.lit(1)).alias("block_docs")))
    # where the partial pass ends: whole blocks before, then a cut inside one block
    run = Window.partitionBy("name").orderBy("block")
    placed = lookup(blocks.withColumn("_upto", F.sum("block_words").over(run)), sources.select("name", "passes", "rest"), "name", F.col("block"))
    placed = placed.withColumn("_before", F.col("_upto") - F.col("block_words"))
    placed = placed.withColumn("_part", F.when(F.col("_upto") <= F.col("rest"), 1).when(F.col("_before") < F.col("rest"), 2).otherwise(0))
    placed = materialize(placed)
    last, _ = size_checked(placed.filter("_part = 2").select("name", "block", "_before", "rest"))
    inside = keyed.join(last, ["name", "block"])
    order = Window.partitionBy("name", "block").orderBy("_k")
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("size").over(order))
    cuts = materialize(inside.filter(F.col("_upto") - F.col("size") / 2.0 <= F.col("rest")).groupBy("name").agg(F.max("_k").alias("cut")))
    placed = lookup(placed, cuts, "name", F.col("block"))
    # the draws: one row a block and pass
    whole = placed.filter("passes >= 1").select(
        "name", "block", F.lit(None).cast("string").alias("cut"), F.explode(F.expr("sequence(1, passes)")).alias("pass"))
    rest = placed.filter("_part = 1 or (_part = 2 and cut is not null)").select(
        "name", "block", F.when(F.col("_part") == 2, F.col("cut")).alias("cut"), (F.col("passes") + 1).alias("pass"))
    draws = split_tree(whole.unionByName(rest), levels, seed)
    table = draws.groupBy("name", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "cut"))).alias("draws"))
    return Plan(sources, materialize(table), seed)


def split_tree(draws: DataFrame, levels: int, seed: str = SEED) -> DataFrame:
    """``draws`` (name, block, pass, ...) with the ``shard`` of each block.

    The left half of a node are the blocks of the lower ranks by mark, the odd
    one included.
    """
    out = draws.withColumn("shard", F.lit(0))
    for level in range(levels):
        mark = F.md5(F.concat_ws("|", F.lit(f"{seed}/{level}"), F.col("shard"), F.col("name"), F.col("block"), F.col("pass")))
        marked = out.withColumn("_mark", mark).withColumn("_lead", F.substring("_mark", 1, RANK_DIGITS))
        node = Window.partitionBy("shard")
        counts = marked.groupBy("shard", "_lead").agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.select(
            "shard", "_lead", F.sum("_n").over(node).alias("_node"),
            F.coalesce(F.sum("_n").over(node.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        ranked = marked.join(F.broadcast(counts), ["shard", "_lead"])  # 16**RANK_DIGITS rows a node at most
        rank = F.col("_before") + F.row_number().over(Window.partitionBy("shard", "_lead").orderBy("_mark"))
        out = ranked.withColumn("shard", F.col("shard") * 2 + F.when(rank * 2 <= F.col("_node") + 1, 0).otherwise(1)).select(*out.columns)
        out = materialize(out)
    return out


def with_shards(docs: DataFrame, plan: Plan, id_col: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """``docs`` plus ``_shards``: one (pass, shard) for every time a row is taken."""
    keyed = _blocks(docs, plan.sources, id_col, source, plan.seed).withColumn("_at", F.struct("_name", "_block"))
    blocks = plan.blocks.select(F.struct(F.col("name").alias("_name"), F.col("block").alias("_block")).alias("_at"), F.col("draws").alias("_draws"))
    joined = lookup(keyed, blocks, "_at", F.col("_k"))
    mine = F.filter("_draws", lambda d: d["cut"].isNull() | (F.col("_k") <= d["cut"]))
    filled = (word_count(F.col("text")) if size is None else size) > 0
    taken = F.when(filled, F.transform(mine, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"))))
    return joined.withColumn("_shards", taken).drop("_k", "_block", "_at", "_draws")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every document, written once."""
    small_batches(docs.sparkSession)
    return materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))


def mix(docs: DataFrame, levels: int = 4, seed: str = SEED) -> DataFrame:
    """The mix itself: ``_row`` (the columns of ``docs``, whatever their names) once for
    every time it is taken, with ``mix_shard`` and ``mix_slot`` (the order inside the shard)."""
    plan = plan_mix(sizes(docs), levels=levels, seed=seed)
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "doc_id", "source", "text")
    out = with_shards(held, plan).withColumn("_draw", F.explode("_shards"))
    slot = F.md5(F.concat_ws("|", F.lit(seed), F.col("_draw.shard"), F.col("_draw.pass"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return out.select("_row", F.col("_draw.shard").alias("mix_shard"), slot.alias("mix_slot"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of the mix with the columns of ``docs`` only, in the order of shard and slot."""
    order = ["mix_shard", "mix_slot"]
    return mix(docs).repartitionByRange(*order).sortWithinPartitions(*order).select("_row.*")


def write_shards(mixed: DataFrame, path: str) -> None:
    """Write one folder a shard, rows in slot order."""
    mixed.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_slot").write.partitionBy("mix_shard").parquet(path)


def mix_rows(docs: DataFrame) -> DataFrame:
    """The contract's columns, and ``shards``: the output shard of each time the mix
    takes the document, in the order of the passes, comma-joined."""
    sized = sizes(docs)
    plan = plan_mix(sized)
    taken = with_shards(sized, plan, size=F.col("size"))
    sources = plan.sources.select(F.col("name").alias("_name"), F.col("words").alias("source_size"), "target")
    out = lookup(taken, sources, "_name", F.xxhash64("doc_id"))
    shards = F.coalesce("_shards", F.expr("cast(array() as array<struct<pass:int,shard:int>>)"))
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size(shards)).cast("long").alias("taken"),
        F.array_join(F.transform(shards, lambda d: d["shard"].cast("string")), ",").alias("shards"))
