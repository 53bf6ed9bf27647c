"""Table operators on small fixed tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.operators import annotation, audit, evaluate, fuzzy, generate, labels, lexicon, linguistic, order, report, suggest
from pairloom.sources import readers, shared, writers
from pairloom.streaming import log


def rows(df, *columns):
    return [tuple(r[c] for c in columns or df.columns) for r in df.collect()]


def words(spark, *values, name="word"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


# -- order -------------------------------------------------------------------


def test_latest_labels_then_join(spark):
    labels_ = spark.createDataFrame([(0, 4, "True"), (1, 1, "False"), (2, 3, "True"), (3, 4, "true")], "ordinal long, source_index long, label string")
    latest = order.keep_last(labels_, ["source_index"], ["ordinal"])
    comments = spark.createDataFrame([(i, f"c{i}") for i in range(6)], "source_index long, text string")
    assert sorted(r["source_index"] for r in readers.labelled_comments(comments, latest).collect()) == [3, 4]


def test_round_robin(spark):
    df = spark.createDataFrame(list(enumerate("aabbc")), "i long, video string")
    assert [r["i"] for r in order.round_robin(df, "video", "i").orderBy("turn", "group_order", "i").collect()] == [0, 2, 4, 1, 3]


def test_keep_first_survives_partitioning(spark):
    df = spark.createDataFrame([(i, i % 7, f"v{i}") for i in range(100)], "o long, k long, v string")
    for n in (1, 5):
        assert sorted(rows(order.keep_first(df.repartition(n), ["k"], ["o"]), "k", "v")) == [(k, f"v{k}") for k in range(7)]


def test_gold_wins(spark):
    gold = spark.createDataFrame([("g", "a", "b")], "id string, s string, t string")
    other = spark.createDataFrame([("x", "a", "b"), ("y", "c", "d")], "id string, s string, t string")
    assert sorted(rows(order.union_keep_first([gold, other], ["s", "t"], ["id"]), "id")) == [("g",), ("y",)]


def test_greedy_spans(spark):
    item = "struct<score:double,start:int,end:int,target:string>"
    df = spark.createDataFrame([([(0.9, 0, 2, "a"), (0.8, 1, 3, "b"), (0.7, 4, 5, "a"), (0.6, 3, 4, "c"), (0.5, 6, 7, "d")],)], f"c array<{item}>")
    assert [x["target"] for x in df.select(order.greedy_spans(F.col("c"), 2).alias("x")).first()["x"]] == ["a", "c"]


def test_group_splits_are_disjoint_and_stable(spark):
    df = spark.createDataFrame([(i, f"d{i % 30}") for i in range(90)], "i long, document_id string")
    parts = {"train": 0.9, "dev": 0.05, "test": 0.05}
    a = order.assign_group_splits(df, "document_id", parts, 17)
    b = order.assign_group_splits(df.repartition(7), "document_id", parts, 17)
    assert sorted(rows(a, "i", "split")) == sorted(rows(b, "i", "split"))
    assert audit.overlap_groups(a, F.col("document_id"), "split").count() == 0
    assert {s for _, s in rows(a, "i", "split")} == set(parts)
    small = spark.createDataFrame([(i, f"v{i % 6}") for i in range(12)], "i long, video string")
    c = order.assign_group_splits(small, "video", {"train": 0.7, "dev": 0.15, "test": 0.15}, mode="deficit")
    assert {s for _, s in rows(c, "i", "split")} == {"train", "dev", "test"}


# -- audit -------------------------------------------------------------------


def test_leakage(spark):
    a = spark.createDataFrame([("same", "x"), ("b", "y")], "s string, t string")
    b = spark.createDataFrame([(" same ", "z")], "s string, t string")
    assert audit.leakage(a, b, "s", "t").first().asDict() == {"input_overlap": 1, "target_overlap": 0, "pair_overlap": 0, "safe": False}
    with pytest.raises(ValueError, match="leakage"):
        audit.require_no_leakage(a, b, "s", "t")


def test_requirements(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, split string")
    with pytest.raises(ValueError, match="missing"):
        audit.require_columns(df, ["nope"])
    with pytest.raises(ValueError, match="duplicate"):
        audit.require_unique(df, ["k"])
    with pytest.raises(ValueError, match="cross"):
        audit.require_disjoint(df, F.col("k"), "split")


def test_reconcile_and_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k long, v string")
    assert dict(rows(audit.reconcile(a, b, "k", ["v"]))) == {1: "orphan", 2: "changed", 4: "missing"}
    assert audit.differing_rows(a, b).count() == 4


def test_invalid_annotations(spark):
    gold = spark.createDataFrame([("1:0", "a", "b"), ("1:1", "c", "d")], "occurrence_id string, informal_token string, formal_token string")
    notes = spark.createDataFrame([("1:0", "a", "b"), ("1:1", "c", "X"), ("9:9", "e", "f")], "occurrence_id string, informal_token string, formal_token string")
    assert dict(rows(annotation.invalid_annotations(notes, gold), "occurrence_id", "issue")) == {"1:1": "token_pair_changed", "9:9": "orphan_occurrence_id"}


# -- lexicons ----------------------------------------------------------------


def test_ibm1_and_alignment(spark):
    shared.set_checkpoints(spark)
    df = spark.createDataFrame([(i, ["kër"], ["maison"]) for i in range(3)] + [(10 + i, ["téere"], ["livre"]) for i in range(3)], "k long, s array<string>, t array<string>")
    table = lexicon.ibm1(df, "k", F.col("s"), F.col("t"), 5).checkpoint()
    best = dict((r["src"], (r["tgt"], r["p"])) for r in lexicon.best_translation(table.filter("src <> ''")).collect())
    assert best["kër"] == ("maison", pytest.approx(1.0)) and best["téere"] == ("livre", pytest.approx(1.0))
    aligned = lexicon.align_best(df, "k", F.col("s"), F.col("t"), table)
    assert {(r["tgt"], r["src"]) for r in aligned.collect()} == {("maison", "kër"), ("livre", "téere")}


def test_capitalized(spark):
    df = words(spark, "Merci Marem", "Bonjour Marem", "Ak Marem", name="text")
    assert ("marem",) in rows(lexicon.capitalized(df, F.col("text"), skip_first=True), "token")


def test_variant_mining(spark):
    shared.set_checkpoints(spark)
    comments = words(spark, *["kham naa"] * 5, name="text")
    sentences = words(spark, *["xam naa"] * 5, name="text")
    got = {r["token"]: r for r in fuzzy.mine_variants(comments, sentences, words(spark, "xam", "naa"), words(spark, "bonjour")).collect()}
    assert got["kham"]["word"] == "xam" and got["kham"]["status"] == "accepted" and got["kham"]["rule_similarity"] == 1.0


# -- generators --------------------------------------------------------------


def test_rule_pairs(spark):
    raw = spark.createDataFrame([(0, "xam ñu"), (1, "  "), (2, "BCEAO xam 2026")], "i long, wolof string")
    made = {r["source_row"]: r for r in generate.rule_pairs(generate.formal_sources(raw, "wolof", "i")).collect()}
    assert set(made) == {0, 2} and made[0]["informal"] == "kham gnou" and made[2]["informal"] == "BCEAO kham 2026" and made[0]["changed"]


def test_aligned_pairs(spark):
    sources = spark.createDataFrame([("p:0", 0, "xam ñu", ["xam", "ñu"], ["savoir", "nous"])], "source_id string, source_row long, formal string, s array<string>, t array<string>")
    lex = spark.createDataFrame([("xam", "savoir", 0.9)], "src string, tgt string, p double")
    r = generate.aligned_pairs(sources, lex, F.col("s"), F.col("t")).first()
    assert r["informal"] == "savoir gnou" and r["edit_count"] == 3 and r["error_types"] == ["alignment_code_switch", "orthographic_rules"]


def test_embedding_candidates(spark):
    pairs = spark.createDataFrame([("p:0", ["xam", "ñu"], ["savoir", "nous"])], "source_id string, s array<string>, t array<string>")
    vectors = spark.createDataFrame([("xam", [1.0, 0.0]), ("savoir", [0.9, 0.1]), ("ñu", [0.0, 1.0]), ("nous", [-1.0, 0.0])], "gram string, vector array<double>")
    lex = spark.createDataFrame([("xam", "savoir", 0.5)], "src string, tgt string, p double")
    got = generate.embedding_candidates(pairs, vectors, lex, F.col("s"), F.col("t")).collect()
    assert [(r["start"], r["target"]) for r in got] == [(0, "savoir")]
    assert got[0]["score"] == pytest.approx(0.9 / (0.82**0.5) * 1.5)


def test_external_audit(spark):
    raw = spark.createDataFrame([
        (0, "Xam naa", "<NON_STANDARD>kham na</NON_STANDARD>"), (1, "xam naa", "<NON_STANDARD>KHAM na</NON_STANDARD>"), (2, "xam", "<NON_STANDARD>XAM</NON_STANDARD>"),
        (3, "dem", "<NON_STANDARD>deme"), (4, "", "<NON_STANDARD>x</NON_STANDARD>")], "i long, wo string, non_standard string")
    got = {r["source_row"]: r for r in generate.external_audit(raw, "i", "wo", "non_standard").collect()}
    assert [got[i]["accepted"] for i in range(5)] == [True, False, False, False, False]
    assert [got[i]["rejection_reasons"] for i in range(1, 5)] == [["duplicate_pair"], ["unchanged_normalized"], ["malformed_wrapper"], ["empty_formal"]]


def test_variant_pairs(spark):
    sources = spark.createDataFrame([("a", 0, "Xam, naa xam")], "source_id string, source_row long, formal string")
    mappings = spark.createDataFrame([("xam", "kham", 0.9)], "formal_token string, informal_token string, score double")
    assert generate.variant_pairs(sources, mappings, 2).first()["informal"] == "kham, naa kham"


def test_evidence_pairs(spark):
    notes = spark.createDataFrame([
        (0, "xool", "khol", "VERB", ["x"], "reviewed", "wo", "wo", "no"), (1, "xool", "khol", "VERB", ["x"], "reviewed", "wo", "wo", "no"), (2, "bonjour", "bjr", "INTJ", [], "reviewed", "fr", "fr", "yes"),
        (3, "dem", "deme", "VERB", ["e"], "uncertain", "wo", "wo", "no")],
        "o long, formal_token string, informal_token string, pos string, error_types array<string>, review_status string, target_language string, source_language string, protected string")
    evidence = annotation.eligible_evidence(notes)
    mappings = annotation.learn_mappings(evidence, "o")
    assert rows(mappings, "formal_key", "informal_surface", "count", "dominance") == [("xool", "khol", 2, 1.0)]
    templates = annotation.learn_templates(evidence)
    sentences = spark.createDataFrame([("s", 0, "man xool ko", ["man", "xool", "ko"])], "source_id string, source_row long, formal string, tokens array<string>")
    tagged = spark.createDataFrame([("s", 1, "xool", "VERB")], "source_id string, at int, token string, pos string")
    found = linguistic.mapping_candidates(sentences, mappings).unionByName(linguistic.template_candidates(tagged, templates))
    assert {r["new"] for r in found.collect()} >= {"khol"}
    budgets = spark.createDataFrame([("s", 1)], "source_id string, budget int")
    made = linguistic.evidence_pairs(sentences, linguistic.mapping_candidates(sentences, mappings), budgets).first()
    assert made["informal"] == "man khol ko" and made["edit_count"] == 1
    assert annotation.error_profile(evidence).first()["change_rate"] == 1.0


# -- suggestions -------------------------------------------------------------


def suggestion(spark, token, formal, foreign=(), protected=()):
    empty = spark.createDataFrame([], "word string")
    table = lambda w: words(spark, *w) if w else empty
    return suggest.suggest(words(spark, token, name="token"), table(formal), table(foreign), table(protected)).first()


def test_suggestions(spark):
    assert suggestion(spark, "abcd", ["abc", "abce"])["category"] in ("ambiguous_formal", "unresolved")
    r = suggestion(spark, "bagn", ["bañ", "xale"])
    assert (r["category"], r["suggestion"]) == ("informal", "bañ")
    assert suggestion(spark, "la", ["la"], ["la"])["category"] == "ambiguous_exact"
    assert suggestion(spark, "bonjour", ["la"], ["bonjour"])["category"] == "foreign_exact"
    assert suggestion(spark, "bonjor", ["la"], ["bonjour"])["category"] == "possible_foreign"
    assert suggestion(spark, "zzzzz", ["la"], ["bonjour"])["category"] == "unresolved"
    assert suggestion(spark, "abc1", ["abc"])["category"] == "protected"


def test_reverse_sentences(spark):
    df = spark.createDataFrame([(1, "kham gnou BCEAO maison 2026")], "k long, text string")
    back = spark.createDataFrame([("maison", "kër", 0.8)], "src string, tgt string, p double")
    got = suggest.reverse_sentences(df, "k", "text", words(spark, "xam", "ñu", "kër"), words(spark, "maison"), back).first()["restored"]
    assert got == "xam ñu BCEAO kër 2026"


def test_replace_words_keeps_separators(spark):
    df = spark.createDataFrame([("man, dama  bagn!", ["a", "b", "c"])], "t string, w array<string>")
    assert df.select(suggest.replace_words(F.col("t"), F.col("w")).alias("x")).first()["x"] == "a, b  c!"


# -- evaluation --------------------------------------------------------------


def score(spark, source, prediction, reference):
    df = spark.createDataFrame([(source, prediction, reference)], "s string, p string, r string")
    return evaluate.scores(df, "p", "r", "s").first()


def test_scores(spark):
    r = score(spark, "man dem", "man dem na", "man dem na")
    assert r["cer"] == 0 and r["wer"] == 0 and r["chrf"] == pytest.approx(100.0) and r["correction_f1"] == 1.0
    r = score(spark, "jàmm", "jàmm rekk", "jàmm")
    assert r["correction_fp"] == 1 and r["overcorrection_rate"] == 1.0 and r["unchanged_sentence_overcorrection_rate"] == 1.0


def test_interval_contains_the_value(spark):
    df = spark.createDataFrame([(i, "abcd", "abcx" if i % 3 else "abcd", "zzcd") for i in range(40)], "k long, p string, r string, b string")
    out = {r["measure"]: r for r in evaluate.bootstrap_cer(df, "p", "r", "b", "k", 300).collect()}
    assert out["cer"]["low"] <= out["cer"]["value"] <= out["cer"]["high"] and out["delta"]["value"] < 0


def test_confusion_and_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, g string")
    assert rows(report.confusion(df, "t", "g", ["a", "b", "c"]).orderBy("position"), "label", "a", "b", "c") == [("a", 1, 1, 0), ("b", 0, 1, 0), ("c", 0, 0, 0)]
    got = {r["label"]: r for r in report.per_class(df, "t", "g").collect()}
    assert got["a"]["precision"] == 1.0 and got["a"]["recall"] == 0.5 and got["b"]["precision"] == 0.5


# -- labels ------------------------------------------------------------------


@pytest.mark.parametrize(("s", "t"), [("abc", "abc"), ("abc", "ac"), ("ac", "abbc"), ("", "xy"), ("xy", "")])
def test_edit_labels_round_trip(spark, s, t):
    df = spark.createDataFrame([(list(s), list(t))], "s array<string>, t array<string>")
    got = df.select(labels.edit_labels(F.col("s"), F.col("t")).alias("l")).select("l", labels.apply_labels(F.col("l")).alias("t")).first()
    assert got["t"] == list(t) and len(got["l"]) == len(s) + 1


def test_masking_is_keyed(spark):
    df = spark.createDataFrame([(1, [f"t{i}" for i in range(40)])], "k long, w array<string>")
    a, b = (df.select(labels.mask_spans(F.col("w"), F.col("k")).alias("m")).first()["m"] for _ in range(2))
    assert a == b and sum(x["target"] is not None for x in a) == 6


# -- sources, sinks, streams -------------------------------------------------


def test_write_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "i long, g string")
    m = writers.write_dataset(df, str(tmp_path / "x"), {"seed": 1}, review=("i", 3), review_by=["g"])
    assert m["rows"] == 20 and readers.read_manifest(spark, str(tmp_path / "x/manifest.json"))["digest"] == m["digest"]
    assert m["digest"] == writers.table_digest(df.repartition(5).select("g", "i"))["digest"]
    assert spark.read.parquet(str(tmp_path / "x/review")).count() == 6
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_dataset(df, str(tmp_path / "x"))
    assert "| i | g |" in writers.markdown(df.limit(2))


def test_replace_and_optional(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    assert readers.load_optional(spark, path, "i long").count() == 0
    for n in (3, 5):
        writers.replace_table(spark.range(n), path)
        assert readers.load_table(spark, path).count() == n


def test_checkpoint_labels(spark, tmp_path):
    (tmp_path / "batch_1.json").write_text('{"1": true, "2": false}')
    (tmp_path / "batch_2.json").write_text('{"2": true}')
    assert rows(readers.checkpoint_labels(spark, str(tmp_path / "batch_*.json"))) == [(1, True), (2, True)]


def test_latest_view_of_a_stream(spark, tmp_path):
    schema = "k long, o long, v string"
    for n, data in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        log.maintain_latest(stream, str(tmp_path / "latest"), ["k"], ["o"], str(tmp_path / "cp")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "latest")).count() == 2, n
    assert dict(rows(spark.read.parquet(str(tmp_path / "latest")), "k", "v")) == {1: "c", 2: "b"}


def test_confirmed_default_and_reconstruction(spark):
    reviews = spark.createDataFrame([(1, "a", "N", 1), (2, "a", "N", 2), (3, "a", "V", 3), (4, "b", "N", 1), (5, "b", "V", 2)], "o long, k string, pos string, x int").drop("x")
    assert rows(annotation.confirmed_default(reviews, "k", ["pos"], "o"), "k", "pos", "reviews") == [("a", "N", 2)]
    payload = '[{"token":"dama"},{"token":"bagn","selected_candidate":"bañ"},{"token":"ko","final_correction":"ko!"}]'
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(T.reconstruct(F.col("p")).alias("x")).first()["x"] == "dama bañ ko!"


def test_apply_if_unchanged(spark):
    base = spark.createDataFrame([(1, 1, "old"), (2, 1, "moved")], "k long, o long, v string")
    ok = spark.createDataFrame([(1, "old", "new")], "k long, expected string, value string")
    assert rows(annotation.apply_if_unchanged(base, ok, "k", "o", "v")) == [(1, 2, "new")]
    with pytest.raises(ValueError, match="changed"):
        annotation.apply_if_unchanged(base, spark.createDataFrame([(2, "x", "y")], "k long, expected string, value string"), "k", "o", "v")


# -- corpus ------------------------------------------------------------------


def test_corpus_drops_gold_and_repeats(spark):
    from pairloom.operators import corpus

    news = spark.createDataFrame([(i, f"sentence number {i} of the news text", f"n{i % 30}") for i in range(90)] + [(150, "GOLD line is here", "n1"), (151, "Sentence number 3 of the news text", "n2")], "row long, text string, document string")
    comments = spark.createDataFrame([(i, f"comment {i} with words enough", f"v{i % 30}") for i in range(90)] + [(190, "sentence number 1 of the news text", "v1"), (191, "kept out entirely here", "gold")], "row long, text string, document string")
    gold, documents = spark.createDataFrame([("gold  line, is here",)], "text string"), spark.createDataFrame([("gold",)], "document string")
    made = corpus.build_corpus(comments, news, gold, documents).collect()
    assert len(made) == 180 and len({r["canonical"] for r in made}) == 180
    assert {r["domain"] for r in made} == {"formal", "informal"} and {r["split"] for r in made} == {"train", "dev", "test"}
    places = {}
    for r in made:
        assert places.setdefault((r["domain"], r["document_id"]), r["split"]) == r["split"]


def test_selector_separates(spark):
    from pairloom.operators import corpus

    data = [(f"waaw jàmm rekk {i}", True, f"d{i % 3}") for i in range(15)] + [(f"bonjour merci beaucoup {i}", False, f"d{i % 3}") for i in range(15)]
    df = spark.createDataFrame(data, "text string, label boolean, document_id string")
    model = corpus.fit_selector(df)
    assert model.probability("jàmm rekk") > 0.5 > model.probability("merci")
    assert corpus.word_grams("ab") == [" ab", "ab ", " ab "]
    assert corpus.selector_audit(df).first()["precision"] == 1.0


def test_training_regimes(spark):
    from pairloom.operators import corpus

    row = "source_id string, method string, source_text string, target_text string, source_type string"
    gold = spark.createDataFrame([("g", "gold", "a", "b", "gold")], row)
    made = spark.createDataFrame([("s", "m", "A ", "b", "synthetic"), ("t", "m", "c", "d", "synthetic")], row)
    assert sorted(rows(corpus.assemble_training(made, gold, "synthetic_plus_gold"), "source_id")) == [("g",), ("t",)]
    with pytest.raises(ValueError, match="regime"):
        corpus.assemble_training(None, gold, "synthetic_only")


# -- automatic rows ----------------------------------------------------------


LOOKUP = "key string, lemma string, pos string, lookup_source string, review_status string, target_language string, entity_type string, protected string, ambiguous_pos boolean, language_ambiguous boolean"
NOTE = "occurrence_id string, source_index string, token_position int, informal_token string, formal_token string, lemma string, pos string, source_language string, target_language string, entity_type string, protected string, error_type string, review_status string, notes string, lookup_source string"


def test_automatic_identities(spark):
    from pairloom.operators import refresh

    occ = spark.createDataFrame([("1:0", "1", 0, "dem", "dem"), ("1:1", "1", 1, "Fatou", "Fatou"), ("1:2", "1", 2, "bi", "bii"), ("1:3", "1", 3, "la", "la"), ("1:4", "1", 4, "dem", "dem")], "occurrence_id string, source_index string, token_position int, informal_token string, formal_token string")
    lookup = spark.createDataFrame([
        ("dem", "dem", "VERB", "seed_lookup", None, "wo", "", "", False, False), ("fatou", "", "PROPN", "name_seed_lookup", None, "unknown", "", "", False, False),
        ("la", "la", "DET", "seed_lookup", None, "wo", "", "", True, False)], LOOKUP)
    done = spark.createDataFrame([("1:4",)], "occurrence_id string")
    got = {r["occurrence_id"]: r for r in refresh.automatic_identities(occ, done, lookup).collect()}
    assert set(got) == {"1:0", "1:1"} and got["1:0"]["protected"] == "no"
    assert (got["1:1"]["entity_type"], got["1:1"]["notes"], got["1:1"]["lemma"]) == ("PERSON", "AUTO_IDENTITY_NAME_LOOKUP", "Fatou")


def test_refresh_classes(spark):
    from pairloom.operators import refresh

    row = lambda i, token, pos, language, source, notes="AUTO_IDENTITY_LOOKUP", entity="UNKNOWN", protected="no": (str(i), "1", i, token, token, token, pos, language, language, entity, protected, "identity", "reviewed", notes, source)
    notes = spark.createDataFrame([
        row(0, "dem", "VERB", "wo", "seed_lookup"), row(1, "dem", "NOUN", "wo", "seed_lookup"), row(2, "bonjour", "INTJ", "fr", "french_seed_lookup", protected="yes"),
        row(3, "jàmm", "NOUN", "wo", "curated_lookup"), row(4, "dem", "NOUN", "wo", "seed_lookup", notes="by hand"), row(5, "Awa", "PROPN", "unknown", "french_seed_lookup", protected="yes")], NOTE)
    lookup = spark.createDataFrame([
        ("dem", "dem", "VERB", "seed_lookup", None, "wo", "", "", False, False), ("bonjour", "bonjour", "INTJ", "french_seed_lookup", None, "fr", "", "", False, False),
        ("awa", "Awa", "NOUN", "french_seed_lookup", None, "fr", "", "", False, False)], LOOKUP)
    names = words(spark, "awa", name="key")
    made = refresh.classify_refresh(notes, lookup, names)
    got = dict(rows(made, "occurrence_id", "refresh"))
    assert got == {"0": "keep", "1": "modified", "2": "remove", "3": "remove", "4": "keep", "5": "modified"}
    done = {r["occurrence_id"]: r for r in refresh.complete_names(made, names).collect()}
    assert done["5"]["migrated"] and done["5"]["entity_type"] == "PERSON" and not done["1"]["migrated"]
    assert all(r["p"] == [] for r in notes.select(refresh.save_problems().alias("p")).collect())


def test_confirmed_mappings_spread(spark):
    from pairloom.operators import refresh

    occ = spark.createDataFrame([("9:0", "9", 0, "kham", "xam")], "occurrence_id string, source_index string, token_position int, informal_token string, formal_token string")
    human = [(str(i), "1", i, "kham", "xam", "xam", "VERB", "wo", "wo", "NONE", "no", "substitution", "reviewed", "", "", i) for i in range(2)]
    notes = spark.createDataFrame(human, NOTE + ", o int")
    r = refresh.automatic_mappings(occ, notes, "o", ["lemma", "pos", "error_type"]).first()
    assert (r["pos"], r["error_type"], r["notes"]) == ("VERB", "substitution", "AUTO_CONFIRMED_MAPPING_DEFAULT") and r["transformation_steps"][0]["new"] == "kh"


def test_features(spark):
    from pairloom.operators import refresh

    notes = spark.createDataFrame([("bonjour", "bonjour", "fr", "fr", "none", "yes"), ("salu", "salut", "fr", "fr", "", "yes"), ("salu", "salu", "wo", "wo", "", "yes")],
                                  "informal_token string, formal_token string, source_language string, target_language string, entity_type string, protected string")
    made = refresh.feature_lookup(notes, words(spark, "Diop", name="value"))
    got = {r[0]: r[1:] for r in rows(made, "key", "is_french", "is_entity", "is_protected")}
    assert got == {"bonjour": (True, False, True), "salut": (True, False, True), "salu": (True, False, False), "diop": (False, True, True)}
    texts = spark.createDataFrame([(1, "Diop, bonjour xam")], "k long, text string")
    assert [r["is_entity"] for r in refresh.word_features(texts, "k", "text", made).orderBy("position").collect()] == [True, False, False]


def test_hybrid_labels():
    assert labels.boundary_labels("ab cd", "abcd") == (["none", "none", "delete", "none", "none"], [0, 0, -1, 1, 1], ["keep", "keep"])
    assert labels.boundary_labels("abcd", "ab cd") == (["none", "none", "insert_before", "none"], [0, 0, 0, 0], ["keep"])
    assert labels.boundary_labels("ab cd", "ab xd")[2] == ["keep", "edit"]


def test_file_audit_and_locks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "ok.txt").write_text("fine\nbad Ã© here\n", encoding="utf-8")
    (tmp_path / "a" / "broken.txt").write_bytes(b"caf\xe9\n")
    (tmp_path / "a" / "x.bin").write_bytes(b"\xff")
    got = sorted((p.rsplit("/", 1)[1], n, i[0]) for p, n, i in rows(audit.audit_files(spark, str(tmp_path / "a"))))
    assert ("ok.txt", 2, "mojibake:Ã") in got and ("broken.txt", 0, "invalid_utf8") in got and not any(p == "x.bin" for p, _, _ in got)
    path = str(tmp_path / "lock.json")
    first = writers.lock_selection(spark, path, {"b": 1, "a": 2})
    assert writers.lock_selection(spark, path, {"a": 2, "b": 1}) == first
    with pytest.raises(ValueError, match="locked"):
        writers.lock_selection(spark, path, {"a": 3})


def test_best_candidates_and_readable_alignment(spark):
    df = spark.createDataFrame([("s", 0.5, 0, 1, "b"), ("s", 0.5, 0, 1, "a"), ("s", 0.4, 1, 2, "c")], "source_id string, score double, start int, end int, target string")
    assert sorted(rows(generate.best_candidates(df), "start", "target")) == [(0, "a"), (1, "c")]
    al = spark.createDataFrame([(1, 1, "y", ""), (1, 0, "x", "a")], "k long, j int, tgt string, src string")
    assert generate.readable_alignment(al, "k").first()["alignment"] == "x<-a y<--"


def test_segment_joins_lose_no_pair(spark):
    import random

    from pairloom.functions import similarity as S
    from pairloom.operators import fuzzy

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abàñn") for _ in range(rng.randrange(0, 9)))
    tokens, vocabulary = {word() for _ in range(70)}, {word() for _ in range(70)}
    t, w = words(spark, *tokens, name="token"), words(spark, *vocabulary, name="word")
    plain = lambda a, b: S.edit_distance(list(a), list(b))
    near = [(a, b) for a in tokens for b in vocabulary if abs(len(a) - len(b)) <= 2]
    for limit, ratio in ((0, None), (1, None), (3, None), (None, 0.34), (None, 0.55), (2, 0.5)):
        want = {(a, b, plain(a, b)) for a, b in near if (limit is None or plain(a, b) <= limit) and (ratio is None or (max(len(a), len(b)) and plain(a, b) / max(len(a), len(b)) <= ratio))}
        got = set(rows(fuzzy.band_join(t, w, 2, limit, ratio), "token", "word", "distance"))
        assert {x for x in got if x[0] or x[1]} == {x for x in want if x[0] or x[1]}, (limit, ratio)
    weighted = lambda a, b: S.edit_distance(list(a), list(b), S.near_pairs(S.REVERSE_LETTERS), S.REVERSE_PRICE)
    for r in fuzzy.best_match(t, w).collect():
        if not r["token"]:
            continue
        a = r["token"]
        found = sorted((weighted(a, b), abs(len(a) - len(b)), b) for b in vocabulary if abs(len(a) - len(b)) <= 2 and weighted(a, b) / max(len(a), len(b)) <= 0.34)
        assert r["word"] == (a if a in vocabulary else found[0][2] if found else None), r


def test_ranks_come_from_range_partitions(spark):
    data = [(i, "hot" if i % 3 else None if i % 2 else f"g{i}") for i in range(200)]
    df = spark.createDataFrame(data, "i long, g string").repartition(7)
    want = {}
    seen = {}
    for i, g in data:
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    assert dict(rows(order.within_group_index(df, "g", ["i"]), "i", "segment_index")) == want


def test_gate_has_five_criteria(spark):
    from pairloom.operators import evaluate

    cols = "condition string, cer double, wer double, correction_f1 double, overcorrection_rate double, correction_tp long"
    base = ("v1", 0.2, 0.5, 0.1, 0.4, 3)
    for row, passed in ((("h", 0.2, 0.4, 0.2, 0.3, 1), True), (("h", 0.21, 0.4, 0.2, 0.3, 1), False), (("h", 0.2, 0.5, 0.2, 0.3, 1), False), (("h", 0.1, 0.4, 0.1, 0.3, 1), False), (("h", 0.1, 0.4, 0.2, 0.4, 1), False), (("h", 0.1, 0.4, 0.2, 0.3, 0), False)):
        assert evaluate.gate(spark.createDataFrame([base, row], cols), "v1", "h").first()["passed"] is passed
