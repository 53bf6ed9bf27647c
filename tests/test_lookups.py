"""Lookups, annotation rules, whole-sentence analysis, embedding pairs, bundles and settings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pairloom.operators import analyze, annotation, corpus, evaluate, generate, labels, lexicon, lookup
from pairloom.operators.refresh import FRENCH, NAMES, SEED
from pairloom.sources import config, readers, writers


def by_key(df, *columns):
    return {r["key"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def seed(spark):
    own = lookup.dictionary_seed(spark.createDataFrame([(0, "Dem", "v"), (1, "dem", "n"), (2, "la", "x"), (3, "xam", "v"), (4, "diop", "n"), (5, " ", "n")], "o long, w string, p string"), "w", "p", None, "o", {"v": "VERB", "n": "NOUN"}, "wo", "no", SEED)
    foreign = lookup.dictionary_seed(spark.createDataFrame([(0, "la", "d", "le"), (1, "bonjour", "i", "bonjour"), (2, "rare", "n", "rare")], "o long, w string, p string, l string"), "w", "p", "l", "o", {"d": "DET", "i": "INTJ", "n": "NOUN"}, "fr", "yes", FRENCH)
    names = lookup.name_seed(spark.createDataFrame([(0, "Diop"), (1, "DIOP"), (2, None)], "o long, n string"), "n", "o")
    units = spark.createDataFrame([("la", "La"), ("bonjour", "Bonjour"), ("jox", "jox")], "key string, formal_token string")
    return lookup.multilingual_seed(own, foreign, names, units).cache(), units


def test_names_win_and_shared_words_are_ambiguous(seed):
    table, units = seed
    got = by_key(table, "formal_token", "pos", "target_language", "lookup_source", "pos_candidates", "entry_count")
    assert got == {
        "dem": ("Dem", "UNKNOWN", "wo", SEED, ["NOUN", "VERB"], 2), "xam": ("xam", "VERB", "wo", SEED, ["VERB"], 1), "diop": ("Diop", "PROPN", "unknown", NAMES, ["PROPN"], 1),
        "la": ("la", "DET", "unknown", lookup.AMBIGUOUS, ["DET"], 2), "bonjour": ("Bonjour", "INTJ", "fr", FRENCH, ["INTJ"], 1)}
    assert by_key(table, "pos_by_language", "lemmas")["la"] == ({"wo": [], "fr": ["DET"]}, ["le"])
    assert lookup.seed_statistics(table, units).first().asDict() == {"entries": 5, "own": 2, "foreign": 1, "names": 1, "ambiguous": 1, "units": 3, "covered": 2}


def test_prefill_and_save_rules(spark, seed):
    table, _ = seed
    pairs = [("dem", "dem"), ("bjr", "bonjour"), ("la", "la"), ("diop", "Diop"), ("nope", "not here"), ("kham", "xam")]
    df = spark.createDataFrame(pairs, "informal_token string, formal_token string")
    got = {r["formal_token"]: r for r in lookup.prefilled(df, table).collect()}
    assert got["dem"]["pos_options"] == ["UNKNOWN", "NOUN", "VERB"] and got["dem"]["pos_editable"] and not got["dem"]["reusable"] and got["dem"]["error_types"] == ["identity"]
    assert got["bonjour"]["error_types"][-1] != "identity" and "french_spelling" in got["bonjour"]["error_types"] and got["bonjour"]["source_language_locked"]
    assert (got["la"]["review_status"], got["la"]["protected"], got["la"]["language_editable"]) == ("uncertain", "uncertain", True)
    assert (got["Diop"]["pos"], got["Diop"]["entity_type"], got["Diop"]["pos_options"]) == ("PROPN", "PERSON", ["PROPN"])
    assert got["not here"]["lemma"] == "" and len(got["not here"]["pos_options"]) > 10 and got["not here"]["reusable"]
    rows = [("kham", "xam", "NOUN", "wo", "PERSON", ["substitution", "identity"]), ("la", "la", "VERB", "mixed", "NONE", ["identity"]), ("la", "la", "DET", "fr", "NONE", ["identity"]), ("xam", "xam", "VERB", "wo", "NONE", ["other"]), ("kham", "xam", "VERB", "wo", "NONE", [])]
    sent = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, informal_token string, formal_token string, pos string, target_language string, entity_type string, error_types array<string>")
    problems = {r["i"]: r["problems"] for r in lookup.save_rules(sent, table).collect()}
    assert problems == {0: ["identity_combined", "identity_on_change", "pos_not_allowed", "person_needs_propn"], 1: ["pos_not_allowed", "language_not_candidate"], 2: [], 3: ["identity_missing"], 4: ["error_types"]}


def test_headwords_units_and_modes(spark):
    words = spark.createDataFrame([(0, " Dem ", "v", "to go"), (1, "dem", "n", "going"), (2, "two words", "n", "x"), (3, "dem", "v", "to go"), (4, None, None, None)], "o long, w string, p string, d string")
    assert [tuple(r) for r in lookup.word_metadata(words, "w", "p", "d", "o").collect()] == [("dem", "n / v", "to go; going")]
    assert lookup.first_column(words, ["p", "w"]) == "w" and lookup.first_column(words, ["z"]) is None
    payload = json.dumps([{"token": "bjr", "final_correction": " Bonjour "}, {"token": "Xam"}, {"token": ""}])
    units = lookup.formal_units(spark.createDataFrame([(1, json.dumps([{"token": "XAM"}])), (0, payload), (2, None)], "o long, j string"), "j", "o")
    assert by_key(units, "formal_token") == {"bonjour": ("Bonjour",), "xam": ("Xam",)}
    notes = spark.createDataFrame([("a", "b", "x", "reviewed"), ("a,", "c", "y", "reviewed"), ("a", "b", "y", "reviewed"), ("a", "a", "z", "uncertain")], "informal_token string, formal_token string, f string, review_status string")
    assert by_key(lookup.modes_of_words(notes, ["f"]), "f") == {"a": ("y",), "b": ("x",), "c": ("y",)}


def test_analysis_of_a_sentence(spark):
    word = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    learned = spark.createDataFrame([("kham", ["xam"]), ("la", ["loo"]), ("def", ["deef", "def"])], "key string, equivalents array<string>")
    text = spark.createDataFrame([(1, "BCEAO, kham la def dem!"), (2, None)], "k long, t string")
    made = analyze.analyze(text, "k", "t", word("dem", "xam", "la"), word("la"), word(), learned)
    got = {r["token"]: r for r in made.collect()}
    assert {t: (r["category"], r["auto"], r["accepted"], r["review_required"]) for t, r in got.items()} == {
        "BCEAO": ("protected", "BCEAO", False, False), "kham": ("learned_correction", "xam", True, False), "la": ("ambiguous_exact", "la", False, True),
        "def": ("ambiguous_learned", "def", False, True), "dem": ("formal_exact", "dem", False, False)}
    assert got["def"]["suggestions"][:2] == ["def", "deef"] and got["BCEAO"]["suggestions"] == ["BCEAO"]
    assert {r["k"]: r["auto"] for r in analyze.automatic_sentences(text, "k", "t", made).collect()} == {1: "BCEAO, xam la def dem!", 2: None}


def test_templates_have_eight_keys(spark):
    rows = [("xool", "khol", "VERB", ["substitution"]), ("xam", "kham", "VERB", ["other", "substitution"]), ("a b", "ab", "VERB", ["other"]), ("dem", "dem", "VERB", ["identity"]), ("max", "makh", "NOUN", ["uncertain"])]
    evidence = spark.createDataFrame(rows, "formal_token string, informal_token string, pos string, error_types array<string>")
    got = {tuple(r[c] for c in ("error_type", "operation", "old", "new", "left", "right", "place")): (r["count"], r["trigger_total"]) for r in annotation.learn_templates(evidence, allowed=["substitution", "deletion"]).collect()}
    assert got == {("substitution", "replace", "xo", "kh", "^", "o", "prefix"): (1, 1), ("substitution", "replace", "x", "kh", "^", "a", "prefix"): (1, 1)}


def test_embedding_pairs_end_to_end(spark, tmp_path):
    pairs = spark.createDataFrame([(f"p:{i}", i, "man xam ñu BCEAO", ["man", "xam", "ñu", "bceao"], ["moi", "savoir", "nous"]) for i in range(6)], "source_id string, source_row long, formal string, s array<string>, t array<string>")
    vectors = generate.train_vectors(pairs, F.col("s"), F.col("t"), 2, size=8, epochs=1)
    lex = lexicon.cooccurrence_lexicon(pairs, F.col("s"), F.col("t"))
    folder = str(tmp_path / "resources")
    manifest = generate.save_resources(vectors, lex, folder)
    again, lexicon_again = generate.load_resources(spark, folder)
    assert manifest["tables"]["lexicon"]["rows"] == lexicon_again.count() and writers.table_digest(again)["digest"] == manifest["tables"]["vectors"]["digest"]
    with pytest.raises(Exception, match="(?i)exist"):
        generate.save_resources(vectors, lex, folder)
    fixed = spark.createDataFrame([("xam_ñu", [1.0, 0.0]), ("savoir_nous", [1.0, 0.1]), ("man", [0.0, 1.0]), ("moi", [0.1, 1.0]), ("xam", [1.0, 0.0]), ("savoir", [1.0, 0.0])], "gram string, vector array<double>")
    found = generate.embedding_candidates(pairs.limit(1), fixed, lex, F.col("s"), F.col("t"))
    made = generate.embedding_pairs(pairs.limit(1), found, F.col("s")).first()
    assert made["informal"].startswith("moi savoir") and made["edit_count"] >= 2 and made["error_types"][0] == "embedding_code_switch"
    assert generate.embedding_pairs(pairs.limit(1), found.limit(0), F.col("s")).first()["error_types"] == ["orthographic_rules"]


def test_bundles_archives_and_recovery(spark, tmp_path):
    df = spark.range(5)
    folder = str(tmp_path / "b")
    manifest = writers.write_bundle({"a": df, "b": df.limit(2)}, folder, {"seed": 1}, {"a": ("id", 3)})
    assert {k: v["rows"] for k, v in manifest["tables"].items()} == {"a": 5, "b": 2} and spark.read.parquet(f"{folder}/a_review").count() == 3
    assert readers.read_manifest(spark, f"{folder}/manifest.json")["config"] == {"seed": 1}
    writers.archive({"a": df}, folder, "v1")
    with pytest.raises(Exception, match="(?i)exist"):
        writers.archive({"a": df}, folder, "v1")
    path = str(tmp_path / "t")
    df.write.parquet(f"{path}.old")
    assert writers.recover_table(spark, path) and spark.read.parquet(path).count() == 5 and not writers.recover_table(spark, path)


def test_scores_are_rejoined_and_stacked(spark):
    raw = spark.createDataFrame([("a", "kham", "xam"), ("b", "dem", "dem")], "source_id string, source_text string, target_text string")
    good = spark.createDataFrame([("b", "dem"), ("a", "xam")], "source_id string, prediction string")
    got = {r["condition"]: (r["rows"], r["exact_match"], r["correction_tp"]) for r in evaluate.stacked_scores(raw, {"identity": None, "good": good}).collect()}
    assert got == {"identity": (2, 0.5, 0), "good": (2, 1.0, 1)}
    with pytest.raises(ValueError, match="without"):
        evaluate.rejoined(good.limit(1), raw)
    with pytest.raises(ValueError, match="duplicate"):
        evaluate.rejoined(good.union(good), raw)
    r = evaluate.corpus_profile(raw.withColumn("c", F.lit("x")), ["c"]).first()
    assert (r["rows"], r["changed_rows"], r["changed_percent"], r["character_edits_mean"], r["word_edits_mean"]) == (2, 1, 50.0, 1.0, 0.5)


def test_comment_filters_in_order(spark):
    data = [(1, "https://x.y"), (2, "bon jour"), (3, "12 34 56"), (4, "les des que naka nga"), (5, "naka nga def les"), (6, None)]
    got = corpus.filtered_comments(spark.createDataFrame(data, "k long, t string"), "k", "t", spark.createDataFrame([("les",), ("des",), ("que",)], "word string"))
    assert [(r["k"], r["cleaned"], r["ratio"]) for r in got.collect()] == [(5, "naka nga def les", 0.25)]


def test_label_lengths_and_profile(spark):
    df = spark.createDataFrame([("ab c", "ab c!!"), ("x", "y")], "s string, t string")
    got = {(r["family"], r["label"]): r["count"] for r in labels.label_profile(df, "s", "t").collect()}
    assert got[("operation", "expand")] == 1 and got[("operation", "substitute")] == 1 and got[("length", "3")] == 1 and got[("length", "1")] == 1 and got[("word", "edit")] == 2
    with pytest.raises(ValueError, match="symbols"):
        labels.MAX_SYMBOLS, held = 1, labels.MAX_SYMBOLS
        try:
            labels.encode_characters(F.lit("a"), spark.createDataFrame([("a", 1), ("b", 2)], "symbol string, code int"), 5, 0, 1)
        finally:
            labels.MAX_SYMBOLS = held


def test_campaign_settings():
    assert config.campaign({}) == config.Campaign()
    assert config.campaign({"CAMPAIGN_SEED": "7", "CAMPAIGN_RESUME": "no", "HOME": "/x"}) == config.Campaign(seed=7, resume=False)
    for broken in ({"CAMPAIGN_SED": "7"}, {"CAMPAIGN_SEED": "x"}, {"CAMPAIGN_RESUME": "perhaps"}):
        with pytest.raises(ValueError, match="."):
            config.campaign(broken)
