"""Column functions against fixed values and plain Python."""

from __future__ import annotations

import random

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pairloom.functions import rules as R
from pairloom.functions import similarity as S
from pairloom.functions import text as T


def value(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("function", "text", "want"), [
    (T.normalize_text, "  Ñu​   dem\nfa  ", "Ñu dem fa"),
    (T.canonical_text, " ÑU  dem ", "ñu dem"),
    (T.compact_text, "Ñu-dem!", "ñudem"),
    (T.normalize_text, "ñu\x07x", "ñux"),
    (T.normalize_text, None, ""),
    (T.compatibility_key, "ﬁn  Straße", "fin strasse"),
    (T.evaluation_text, " A  b ", "A b"),
    (T.clean_comment, "Look https://x.y/z @me at 12:30 Now!!! ok??", "look at now! ok?"),
    (T.token_edges, "«Jàmm!»", "jàmm"),
    (T.unwrap, "<NON_STANDARD> kham  naa </NON_STANDARD>", "kham naa"),
])
def test_text_functions(spark, function, text, want):
    assert value(spark, function(F.col("text")), text) == want


def test_signature_folds_and_strips(spark):
    assert value(spark, T.signature(F.col("text")), "khoolgn") == value(spark, T.signature(F.col("text"), full_marks=True), "xolñ")
    assert value(spark, T.without_diacritics(F.col("text")), "ñàŵ") == "naw"


@pytest.mark.parametrize(("text", "limit", "want"), [
    ("ab cd ef gh ij", 5, ["ab cd", "ef gh", "ij"]), ("", 5, []), ("abcdefghijk lm", 5, ["abcde", "fghij", "k", "lm"]), ("a bcdefgh i j", 4, ["a", "bcde", "fgh", "i j"])])
def test_segments(spark, text, limit, want):
    assert value(spark, T.segment_text(F.col("text"), limit), text) == want


@pytest.mark.parametrize(("text", "usable"), [("abcde fg", True), ("abcd 12 3", False), ("abcdefghij", False), ("http://a.b/cdefgh xy", False), (None, False)])
def test_usable(spark, text, usable):
    assert value(spark, T.usable_text(F.col("text")), text) is usable


def test_token_hash(spark):
    assert value(spark, T.token_hash(F.col("text")), "Wolof_ñu") == 2265038418


def test_tokenizers(spark):
    text = "L’été d'or, xam-xam 2x ÑU_é!"
    assert value(spark, T.tokens(F.col("text"), "alpha"), text) == ["l’été", "d'or", "xam-xam", "x", "ñu", "é"]
    assert value(spark, T.tokens(F.col("text"), "vocabulary"), text) == re.findall(r"\b\w+\b", text)
    assert value(spark, T.tokens(F.col("text"), "evaluation"), text) == re.findall(r"\w+(?:[-’']\w+)*|[^\w\s]", text.casefold())
    assert value(spark, T.tokens(F.col("text"), "word"), text) == re.findall(r"\w+(?:[-'’]\w+)*", text.lower())


def test_ngrams(spark):
    words = F.split("text", " ")
    assert value(spark, T.ngrams(words, 3), "a b c") == ["a", "b", "c", "a_b", "b_c", "a_b_c"]
    assert value(spark, T.ngrams(words, 3), "a") == ["a"]
    assert value(spark, T.character_ngrams(F.col("text")), "a") == ["^a$"]
    assert value(spark, T.character_ngrams(F.col("text")), "aaaa") == ["^aa", "aaa", "aa$"]


@pytest.mark.parametrize(("text", "status"), [("<NON_STANDARD>x</NON_STANDARD>", "valid"), ("x", "absent"), ("<non_standard>x", "malformed"), (None, "absent")])
def test_wrapper(spark, text, status):
    assert value(spark, T.wrapper_status(F.col("text")), text) == status


@pytest.mark.parametrize(("text", "want", "counts"), [
    ("ñu", "gnou", {"enye_to_gn": 1, "u_to_ou": 1}),
    ("xam ñu", "kham gnou", None),
    ("BCEAO xam 2026", "BCEAO kham 2026", None),
    ("  ", "  ", {}),
])
def test_rules(spark, text, want, counts):
    got = value(spark, R.informalize(F.col("text")), text)
    assert got["text"] == want
    assert counts is None or dict(got["counts"]) == counts


def test_rules_in_the_jvm_agree(spark):
    words = ["xam ñu jàmm", "dëkk bi mooy", "caat la-a-lu gée", "cc njuuj thiaw", "éeg gis bën", "uut bule"]
    df = spark.createDataFrame([(w,) for w in words], "text string")
    for r in df.select("text", R.informalize_plain(F.col("text")).alias("a"), R.informalize(F.col("text")).alias("b")).collect():
        assert r["a"] == r["b"]["text"], r["text"]


def test_protected_stretches_unite():
    text = "aa AB12.5 cd 7"
    assert R.protected_parts(text, []) == (f"aa {R.MARK}.{R.MARK} cd {R.MARK}", ["AB12", "5", "7"])
    assert R.protected_parts(text, [(0, 1), (1, 4), (-3, 1), (13, 99)])[1] == ["aa AB12", "5", "7"]
    marked, kept = R.protected_parts(f"x{R.MARK}y", [])
    assert marked.count(R.MARK) == 1 and kept == [R.MARK]


def test_rules_with_counts_agree_with_python(spark):
    rng = random.Random(3)
    letters = "aàáâäbceéèëiïjgqxñŋnoóuthkdl ACDÀ09.,-__U\u4e00'\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(600)] + [None, "", " \n", "ABC", "12,5", "guddi"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", R.informalize(F.col("t")).alias("x"), R.informalize(F.col("t"), in_jvm=True).alias("y")).collect():
        want = R.informalize_one(texts[r["i"]])
        assert (r["x"]["text"], r["x"]["counts"]) == want == (r["y"]["text"], r["y"]["counts"])


def test_distances(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("dëkk", "dekk"), ("", "")], "a string, b string")
    got = [(r["s"], r["w"]) for r in df.select(S.similarity(F.col("a"), F.col("b")).alias("s"), S.weighted_distance(F.col("a"), F.col("b")).alias("w")).collect()]
    assert got[0][0] == pytest.approx(1 - 3 / 7) and got[1] == (0.75, 0.35) and got[2] == (1.0, 0.0)
    assert S.edit_distance(["a", "b"], ["b"]) == 1


def test_edit_scripts_and_alignment():
    assert S.opcodes(list("abc"), list("axc")) == [("replace", 1, 2, 1, 2)]
    assert S.backtrace(["a", "b"], ["a", "c", "b"]) == [("keep", "a", "a"), ("insert", None, "c"), ("keep", "b", "b")]


def test_booleans(spark):
    df = spark.createDataFrame([("True",), ("0",)], "text string")
    assert [r[0] for r in df.select(T.strict_boolean(F.col("text"))).collect()] == [True, False]
    assert value(spark, T.lenient_boolean(F.col("text")), "yes") is True
    with pytest.raises(Exception, match="not a boolean"):
        value(spark, T.strict_boolean(F.col("text")), "maybe")


def test_nfkc_matches_python(spark):
    text = "ﬁ ① é́ ½"
    assert value(spark, T.unicode_form(F.col("text"), "NFKC"), text) == unicodedata.normalize("NFKC", text)


@pytest.mark.parametrize(("informal", "formal", "want"), [
    ("xam", "xam", ["identity"]), ("XAM", "xam", ["capitalization"]), ("nu", "ñu", ["diacritic"]), ("mangi dem", "mangidem", ["spacing_split"]),
    ("khol", "xol", ["substitution"]), ("xaaam", "xam", ["repetition", "insertion"]), ("bjr", "bonjour", ["abbreviation", "deletion"]), ("dem!", "dem", ["insertion", "punctuation"]),
])
def test_error_types(informal, formal, want):
    from pairloom.functions.errors import error_types_of

    assert error_types_of(informal, formal) == want


def test_slots_read_back():
    from pairloom.functions.errors import slots_of, spread

    got = slots_of(["dama", "bagn", "ko"], "man dama bañ ko léegi")
    assert " ".join(got) == "man dama bañ ko léegi" and got[0].startswith("man ") and got[-1].endswith(" léegi")
    assert spread(3, ["a"]) == ["a", "", ""] and spread(2, ["a", "b", "c"]) == ["a b", "c"] and spread(2, []) == ["", ""]


@pytest.mark.parametrize(("response", "want"), [
    ('```json\n[{"id": 1, "label": true}, {"id": 2, "label": false}]\n```', {1: True, 2: False}), ('[{"id": 1, "label": true}]', None), ('[{"id": "1", "label": true}]', None), ("no", None), (None, None)])
def test_model_responses(response, want):
    from pairloom.functions.errors import labels_of

    assert labels_of(response, [1, 2]) == want
