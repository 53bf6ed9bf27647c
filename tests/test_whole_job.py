"""Registered queries do the whole job on small tables of their own."""

from __future__ import annotations

import __spark_entry__ as entry_point


def query(spark, folder, name, **tables):
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return entry_point.queries()[name](spark, str(folder))


def test_mined_variants_from_five_occurrences(spark, tmp_path):
    docs = spark.createDataFrame([("lower djamme rekk",)] * 5 + [("lower rare rekk",)] * 4, "text string")
    held = spark.createDataFrame([("lower jamme rekk",)], "text string")
    got = {r["token"]: r["frequency"] for r in query(spark, tmp_path, "mined_variants", documents=docs, benchmark=held).collect()}
    assert got == {"djamme": 5}


def test_ibm1_lexicon_runs_five_rounds_and_keeps_small_p(spark, tmp_path):
    names = [(1, "red green", "BIG TIN"), (2, "red blue", "BIG STEEL"), (3, "green blue red", "BIG TIN STEEL"), *[(k, "red", "BIG") for k in range(4, 40)]]
    part = spark.createDataFrame([(*r, "b") for r in names], "p_partkey long, p_name string, p_type string, p_brand string")
    got = {(r["src"], r["tgt"]): r["p"] for r in query(spark, tmp_path, "ibm1_lexicon", part=part).collect()}
    pairs = [([""] + n.split(), t.lower().split()) for _, n, t in names]
    table = {(s, t): 1.0 for a, b in pairs for s in a for t in b}
    for _ in range(5):
        made = dict.fromkeys(table, 0.0)
        for a, b in pairs:
            for t in b:
                z = sum(table[s, t] for s in a)
                for s in a:
                    made[s, t] += table[s, t] / z
        total = {s: sum(c for (x, _), c in made.items() if x == s) for s, _ in made}
        table = {k: c / total[k[0]] for k, c in made.items()}
    assert got.keys() == table.keys() and all(abs(got[k] - p) < 1e-7 for k, p in table.items())
    assert min(table.values()) < 0.01


def test_error_interval_draws_five_thousand(spark, tmp_path):
    from pairloom.operators import evaluate
    from pairloom.plans import evaluation

    part = spark.createDataFrame([(i, f"{w} jaamm {w}", "b") for i, w in enumerate(["xool", "dem", "waaw", "rekk", "naa"] * 6)], "p_partkey long, p_name string, p_brand string")
    got = query(spark, tmp_path, "error_interval", part=part).collect()
    want = evaluate.bootstrap_cer(evaluation._predictions(spark, str(tmp_path)), "prediction", "reference", "source", "k", 5000).collect()
    assert got == want


def test_selector_fits_on_more_rows_than_the_driver_held(spark):
    from pyspark.sql import functions as F

    from pairloom.operators import corpus

    df = spark.range(100_002).select(F.when(F.col("id") % 2 == 0, "waaw rekk").otherwise("merci bien").alias("text"), (F.col("id") % 2 == 0).alias("label"))
    model = corpus.fit_selector(df)
    assert model.probability("waaw rekk") > 0.9 and model.probability("merci bien") < 0.1


def test_interval_of_more_rows_than_the_driver_held(spark):
    from pyspark.sql import functions as F

    from pairloom.operators import evaluate

    df = spark.range(100_002).select("id", F.lit("abcd").alias("p"), F.when(F.col("id") % 4 == 0, "abcx").otherwise("abcd").alias("r"))
    got = evaluate.bootstrap_cer(df, "p", "r", None, "id", 200).first()
    error = (0.25 * 0.75 / 100_002) ** 0.5 / 4
    assert abs(got["value"] - 0.0625) < 1e-5 and 3 * error < got["high"] - got["low"] < 5 * error


def test_interval_does_not_hang_on_the_buckets(spark):
    from pairloom.operators import evaluate

    df = spark.createDataFrame([(i, "abcd", "abcx" if i % 3 else "abcd", "zzcd") for i in range(400)], "k long, p string, r string, b string")
    one, many = ([tuple(r)[1:] for r in evaluate.bootstrap_cer(df.repartition(k), "p", "r", "b", "k", 2000, bucket_rows=size).collect()] for k, size in ((2, 1000), (5, 40)))
    assert all(abs(x - y) < 0.01 for a, b in zip(one, many, strict=True) for x, y in zip(a, b, strict=True))
    assert many == [tuple(r)[1:] for r in evaluate.bootstrap_cer(df, "p", "r", "b", "k", 2000, bucket_rows=40).collect()]


def test_whole_comments_keep_letters_and_word_limits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "Été\nÀ Dakar 😀 https://x.y/é @me\tJÀMM!!! ok??"), (2, "naka\nnga\u00a0def"), (3, None)], "page_id long, html string")
    got = {r["page_id"]: r["cleaned"] for r in query(spark, tmp_path, "cleaned_comments", pages=pages).collect()}
    assert got == {1: "été à dakar jàmm! ok?", 2: "naka nga def", 3: ""}


def test_whole_neighbours_count_every_character(spark, tmp_path):
    texts = ["jàmm rekk", "jamm\nrekk", "ñaata 😀", "naata"]
    got = query(spark, tmp_path, "neighbour_similarity", benchmark=spark.createDataFrame(list(enumerate(texts)), "item_id long, text string"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {i: distance(a, b) for i, (a, b) in enumerate(zip(texts, texts[1:], strict=False))}
    assert {r["item_id"]: r["distance"] for r in got.collect()} == want


def test_contexts_and_grid_leave_no_rows_out(spark, tmp_path):
    docs = spark.createDataFrame([(1, "fr", "vin de table"), (2, "es", "casa de campo")], "doc_id long, lang string, text string")
    got = {(r["token"], r["context"], r["count"]) for r in query(spark, tmp_path, "token_contexts", documents=docs).collect()}
    assert got == {("de", w, 1) for w in ("vin", "table", "casa", "campo")}
    part = spark.range(1, 20).withColumnRenamed("id", "p_partkey")
    assert {r[0] for r in query(spark, tmp_path, "missing_runs", part=part).collect()} == set(range(1, 20)) - {9, 18}
