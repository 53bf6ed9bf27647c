"""Work that must not grow faster than its input, or stand in one task."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from pairloom.functions import similarity as S
from pairloom.operators import annotation, corpus, fuzzy, generate, labels, lexicon, linguistic, overlap
from pairloom.plans import lexicons, texts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_profile_counts_distinct_pairs_in_many_tasks(spark):
    df = spark.createDataFrame([("ab cd", "ab xd"), (None, "a"), ("a", None), ("ab cd", "ab xd"), ("", "")], "s string, t string")
    made = labels.label_profile(df, "s", "t")
    # a path for each distinct pair, spread whatever the size of the input's files
    assert "REPARTITION_BY_NUM" in plan(made) and "Arrow" in plan(made)
    got = {(r["family"], r["label"]): r["count"] for r in made.collect()}
    assert got == {
        ("operation", "keep"): 12, ("operation", "substitute"): 2, ("operation", "expand"): 1, ("operation", "delete"): 1, ("length", "1"): 2, ("length", "2"): 1,
        ("boundary", "none"): 9, ("boundary", "keep"): 2, ("word", "keep"): 2, ("word", "edit"): 3}


def test_edit_paths_of_long_texts(spark):
    rng = random.Random(5)
    a, b = ([rng.choice("abcdefgh") for _ in range(12_000)] for _ in range(2))
    start = time.time()
    path = S.backtrace(a, b)
    # 144 M cells: seven to ten seconds with a number a cell
    assert time.time() - start < 4
    assert [s for _, s, _ in path if s is not None] == a and [t for _, _, t in path if t is not None] == b
    df = spark.createDataFrame([("a b d", "a c d e"), (None, "x"), ("", None)], "a string, b string")
    got = [tuple(r["c"]) for r in df.select(S.edit_counts(F.col("a"), F.col("b"), " +").alias("c")).collect()]
    assert got == [(2, 1, 0, 1), (0, 1, 0, 0), (1, 0, 0, 0)]


def test_edit_paths_are_spread_by_number(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "a c d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = lexicons.document_edit_paths(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in plan(made)
    assert [tuple(r) for r in made.collect()] == [(1, 1, 1, 0, 1)]


def test_texts_travel_in_small_batches_and_are_normalised_once(spark, tmp_path):
    spark.createDataFrame([(1, "Cafe\u0301  \u200bA\x01b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    made = texts.normalized_text(spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    assert plan(made).split("== Initial")[0].count("ArrowEvalPython") == 1 and plan(made).count("normal(text") <= 2
    assert sorted(map(tuple, made.collect())) == [(1, "Café Ab", "café ab", "caféab"), (2, "", "", "")]


def test_corpus_texts_are_normalised_once(spark):
    rows = spark.createDataFrame([(1, "Some  words\there www.x.yz", "d1"), (2, "x", "d2"), (3, "other words there", "d3"), (4, "more words again", "d4")], "row long, text string, document string")
    made = rows.withColumn("text", corpus.T.normalized_once(F.col("text"))).filter(corpus.T.usable_text(F.col("text"))).withColumn("canonical", corpus.T.casefold(F.col("text")))
    assert plan(made).count("ArrowEvalPython") == 1
    assert [r["canonical"] for r in made.orderBy("row").collect()] == ["some words here www.x.yz", "other words there", "more words again"]


def test_many_texts_are_scored_as_each(spark):
    grams = corpus.word_grams("waaw rekk merci bien ab")
    model = corpus.Selector({g: 1 + i / 7 for i, g in enumerate(dict.fromkeys(grams))}, {g: (-1) ** i * i / 5 for i, g in enumerate(dict.fromkeys(grams))}, 0.25)
    given = ["waaw waaw merci", None, "", "unknown", "Bien REKK ab\nab ab"]
    assert abs(model.probabilities(given) - [model.probability(t) for t in given]).max() < 1e-12
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    assert [r["s"] for r in df.select(corpus.select_score(F.col("t"), model).alias("s"), "i").orderBy("i").collect()] == list(model.probabilities(given))


def test_rules_and_error_types_run_once_a_distinct_text(spark):
    sources = spark.createDataFrame([("a", 1, "xar bu"), ("b", 2, "xar bu")], "source_id string, source_row long, formal string")
    made = generate.rule_pairs(sources)
    assert "REPARTITION_BY_NUM" in plan(made)
    assert made.select("informal").distinct().count() == 1 and made.count() == 2
    evidence = spark.createDataFrame([("xar", "khar"), ("xar", "khar"), (None, "a"), ("a", None)], "formal_token string, informal_token string")
    found = annotation.with_error_types(evidence).filter("size(error_types) > 0")
    # the filter stays above the distinct
    assert plan(found).count("+- ArrowEvalPython") == 1 and "REPARTITION_BY_NUM" in plan(found)
    assert sorted(map(str, (r["formal_token"] for r in found.collect()))) == ["None", "a", "xar", "xar"]


def test_only_wanted_triggers_are_grouped(spark):
    words = spark.createDataFrame([("abab", "X"), ("xyz", "X")], "token string, pos string")
    templates = spark.createDataFrame([("X", "a", "b", "a", "internal")], "pos string, left string, old string, right string, place string")
    got = linguistic.trigger_sites(words, 1, templates).collect()
    assert [(r["token"], r["site"]) for r in got] == [("abab", 2)]


def test_neighbours_of_many_targets_are_counted_where_the_texts_stand(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "FEW_TARGETS", 1)
    monkeypatch.setattr(lexicon, "NEAR_WORDS", 40)
    rng = random.Random(3)
    names = [f"w{i}" for i in range(12)] + ["ééa", "khaa"]
    texts = [[rng.choice(names) for _ in range(rng.randrange(9))] for _ in range(60)] + [["w1", "w2"] * 500]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "w array<string>").repartition(3)
    targets = spark.createDataFrame([(t,) for t in ("w1", "w2", "ééa", "w1", "absent", None)], "token string")
    want = {}
    for t in texts:
        for i, w in enumerate(t):
            for c in t[max(i - 2, 0) : i] + t[i + 1 : i + 3] if w in ("w1", "w2", "ééa") else ():
                want[w, c] = want.get((w, c), 0) + 1
    for tasks in (None, 5):
        made = lexicon.contexts(df, F.col("w"), targets, 2, 100, fold=False, tasks=tasks)
        assert {(r["token"], r["context"]): r["count"] for r in made.collect()} == want
    # one shuffle of the texts' side, also where the targets are not broadcast: what stands below it is counted already
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(lexicon.contexts(df, F.col("w"), targets, 2, 100, fold=False, tasks=5)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counted = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    dealt = [x for x in lines[:counted] if "Exchange" in x]
    assert len(dealt) == 1 and ", 5), REPARTITION_BY_NUM" in dealt[0]
    top = {(r["token"], r["context"]): r["count"] for r in lexicon.contexts(df, F.col("w"), targets, 2, 3, fold=False).collect()}
    ranked = {w: sorted((-n, c) for (x, c), n in want.items() if x == w)[:3] for w in ("w1", "w2", "ééa")}
    assert top == {(w, c): -n for w, best in ranked.items() for n, c in best}
    rows = lexicon._grouped_near(df.coalesce(1), F.col("w"), targets.filter("token = 'w1'"), 2)
    assert rows.filter("token = 'w1'").count() < sum("w1" in t for t in texts) and "w2" not in {r["token"] for r in rows.collect()}
    assert lexicon.near_tasks(spark.createDataFrame([("a", 3_000_000), ("b", 5)], "token string, count long"), 2) == 13


def test_mining_shuffles_candidates_as_numbers(spark):
    tokens = spark.createDataFrame([("abcd", [1, 2, 3], 4), ("x", [9], 1)], "token string, elements array<bigint>, size int")
    words = spark.createDataFrame([(0, [1, 2, 3], 9), (1, [1, 2], 5), (2, [3], 4), (3, [1, 3], 1)], "wid int, elements array<bigint>, size int")
    made = overlap.top_overlaps(tokens, words, 3, 3)
    assert dict(made.dtypes)["near"] == "array<int>"
    assert {r["token"]: r["near"] for r in made.collect()} == {"abcd": [1, 3], "x": []}
    bags = spark.createDataFrame([("a", "s", 0.5, [0, 1], [7], [2]), ("b", "t", 0.1, [1], [], [])], "token string, _s string, frequency_score double, candidates array<int>, keys array<bigint>, counts array<bigint>")
    named = spark.createDataFrame([(0, "u", "u", [7, 8], [1, 1]), (1, "v", "w", [], [])], "wid int, word string, form string, keys array<bigint>, counts array<bigint>")
    got = {r["token"]: r for r in overlap.bag_scores(bags, named, ("_s", "frequency_score")).collect()}
    assert [tuple(x) for x in got["a"]["found"]] == [("u", "u", 1 / 3), ("v", "w", 0.0)] and (got["a"]["_s"], got["b"]["frequency_score"]) == ("s", 0.1)
    # scores need nothing that is not in the row, so the candidates are not shuffled
    assert "Join" not in plan(fuzzy._two_best(overlap.bag_scores(bags, named, ("_s", "frequency_score"))))


def test_batches_of_long_texts_are_bounded_in_bytes(spark, tmp_path):
    from pairloom.plans import selection

    made = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "fr").otherwise("es").alias("lang"), F.concat(F.repeat(F.lit("é"), 50_000), F.floor(F.col("id") / 2).cast("string")).alias("text"))
    made.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert selection.matched_sets(spark, str(tmp_path)).count() == 200

    @F.arrow_udf("long")
    def size(texts: pa.Array) -> pa.Array:
        return pa.array([sum(len(x.as_buffer()) for x in texts)] * len(texts), pa.int64())

    # 20 MB of text, which 256 rows alone would take at once
    held = spark.read.parquet(f"{tmp_path}/documents.parquet").select(size("text").alias("n")).agg(F.max("n"), F.count("n")).first()
    assert held[0] <= 5 << 20 and held[1] == 200
