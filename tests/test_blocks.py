"""IBM model 1 in blocks against EM over plain dictionaries."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.operators import lexicon

SCHEMA = "k long, s array<string>, t array<string>"


def _brute(pairs, rounds):
    cells = [(k, a, n, b, m) for k, s, t in pairs for a, n in Counter(["", *(x for x in s or () if x is not None)] if s is not None else []).items() for b, m in Counter(x for x in t or () if x is not None).items()]
    p = {(a, b): 1.0 for _, a, _, b, _ in cells}
    for _ in range(rounds):
        norm, count, total = Counter(), Counter(), defaultdict(float)
        for k, a, n, b, _ in cells:
            norm[k, b] += n * p[a, b]
        for k, a, n, b, m in cells:
            count[a, b] += m * n * p[a, b] / norm[k, b]
        for (a, _), c in count.items():
            total[a] += c
        p = {(a, b): c / total[a] for (a, b), c in count.items()}
    return p


def _pairs():
    rng = random.Random(3)
    data = [(i, [f"s{rng.randrange(12)}" for _ in range(rng.randrange(6))], ["le", *(f"t{rng.randrange(9)}" for _ in range(rng.randrange(5)))]) for i in range(120)]
    return data + [(500, None, ["t1"]), (501, ["s1"], None), (502, ["s1", None, "s1"], [None, "le", "le"]), (503, [], ["only"])]


@pytest.mark.parametrize("block, slot", [(250_000, 50_000), (90, 30)])
def test_blocks_equal_plain_rounds(spark, monkeypatch, block, slot):
    monkeypatch.setattr(lexicon, "BLOCK", block)
    monkeypatch.setattr(lexicon, "SLOT", slot)
    got = {(r["src"], r["tgt"]): r["p"] for r in lexicon.ibm1(spark.createDataFrame(_pairs(), SCHEMA), "k", F.col("s"), F.col("t"), 4).collect()}
    want = _brute(_pairs(), 4)
    assert got.keys() == want.keys()
    assert all(got[c] == pytest.approx(want[c], rel=1e-9) for c in want)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cells_")]


def test_no_pairs(spark):
    assert lexicon.ibm1(spark.createDataFrame([], SCHEMA), "k", F.col("s"), F.col("t"), 2).count() == 0


def test_a_round_does_not_shuffle_the_cells(spark):
    rows = spark.range(3_000).select((F.col("id") % 7).alias("block"), "id")
    rows.write.mode("overwrite").bucketBy(4, "block").saveAsTable("bucketed_blocks")
    other = spark.range(7).select(F.col("id").alias("block"), F.lit(1.0).alias("p"))
    joined = spark.table("bucketed_blocks").groupBy("block").cogroup(other.groupBy("block")).applyInArrow(lambda a, b: a.select(["block", "id"]), "block long, id long")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert joined.count() == 3_000
    spark.sql("DROP TABLE bucketed_blocks")
