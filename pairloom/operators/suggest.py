"""Token suggestions from a formal and a foreign lookup, and the reverse mapping of sentences.

All decisions are made on distinct tokens and joined back; candidates come from
segment joins cut by the built-in distance, and only what is left sees
the weighted distance.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import similarity as S
from ..functions import text as T
from . import audit, fuzzy, lexicon

#: Informal spellings and the formal letters they may stand for.
REWRITES = (("kh", "x"), ("eu", "ë"), ("gn", "ñ"), ("th", "c"), ("dj", "j"), ("ou", "u"))
#: Thresholds of the suggestion ladder.
MAX_RATIO, SHORT_RATIO, MARGIN, FOREIGN_MARGIN = 0.24, 0.18, 0.06, 0.04
SHORTLIST, SHORTLIST_LIMIT, RATIO_LIMIT, STEP_PRICE, TOP = 0.55, 48, 0.48, 0.12, 6
#: Reverse rules, a pattern and what it may have been.
REVERSE_RULES = (
    ("ou", ("u", "ou")), ("eu", ("ë", "eu")), (r"é\b", ("e", "é")), (r"ne\b", ("n", "ne")), ("gn", ("ñ", "gn")), ("ng", ("ŋ", "ng")),
    ("thi", ("ci", "thi")), ("th", ("c", "th")), ("kh", ("x", "q", "kh")), ("dio", ("ju", "dio")), ("dj", ("ji", "dj")), ("di", ("je", "ja", "dë", "di")),
    ("a", ("a", "à", "â", "aa")), ("e", ("e", "é", "ée", "ee")), ("o", ("o", "ó", "oo")), ("g", ("g", "gg")),
)


def variants_of(token: str, limit: int = 24) -> dict[str, int]:
    """Spellings reached by the rewrites, with the fewest rewrites that lead there."""
    steps = {token: 0}
    open_ = [token]
    for old, new in REWRITES:
        for v in list(open_):
            w = v.replace(old, new)
            if w != v and steps[v] + 1 < steps.get(w, 99):
                steps[w] = steps[v] + 1
                if w not in open_:
                    open_.append(w)
        del open_[limit:]
    return steps


def _variants(token: Column) -> Column:
    @F.arrow_udf("array<struct<variant:string,steps:int>>")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([[{"variant": v, "steps": n} for v, n in sorted(variants_of(t).items(), key=lambda x: (x[1], x[0]))] for t in values.to_pylist()],
                        pa.list_(pa.struct([("variant", pa.string()), ("steps", pa.int32())])))

    return run(token)


def reverse_candidates_of(token: str, limit: int = 60) -> list[str]:
    """Formal-looking spellings: every rule branches at its first site; shortest stay, then by letters."""
    found = {token}
    for pattern, replacements in REVERSE_RULES:
        fresh = set(found)
        for c in found:
            m = re.search(pattern, c)
            if m:
                fresh.update(c[: m.start()] + r + c[m.end() :] for r in replacements)
        found = fresh if len(fresh) <= limit else set(sorted(fresh, key=lambda c: (len(c), c))[:limit])
    return sorted(found)


def reverse_candidates(token: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([reverse_candidates_of(t) for t in values.to_pylist()], pa.list_(pa.string()))

    return run(token)


def formal_candidates(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, candidates): the best formal words, array<struct<score, word>> in order."""
    spelled = tokens.select("token", F.explode(_variants(F.col("token"))).alias("v")).select("token", "v.variant", "v.steps")
    near = fuzzy.band_join(spelled.select(F.col("variant").alias("token")), words, 2, ratio=SHORTLIST)
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.col("distance") / F.greatest(F.length("token"), F.length("word"), F.lit(1)), "word"))
    short = near.withColumn("_r", rank).filter(F.col("_r") <= SHORTLIST_LIMIT).select(F.col("token").alias("variant"), "word")
    listed = spelled.join(short, "variant").select("token", "word").distinct()
    priced = listed.join(spelled, "token").withColumn("_d", S.weighted_distance(F.col("variant"), F.col("word")) + STEP_PRICE * F.col("steps"))
    best = priced.groupBy("token", "word").agg(F.min(F.col("_d") / F.greatest(F.length("token"), F.lit(1))).alias("score")).filter(F.col("score") <= RATIO_LIMIT)
    return best.groupBy("token").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "word"))), 1, TOP).alias("candidates"))


def nearest_foreign(tokens: DataFrame, words: DataFrame) -> DataFrame:
    near = fuzzy.band_join(tokens, words, 2, ratio=min(0.5, MAX_RATIO + 0.12)).withColumn("score", F.col("distance") / F.greatest(F.length("token"), F.length("word"), F.lit(1)))
    best = F.min_by(F.struct("word", "score"), F.struct("score", "word"))
    return near.groupBy("token").agg(best.alias("_b")).select("token", F.col("_b.word").alias("foreign_word"), F.col("_b.score").alias("foreign_score"))


def suggest(tokens: DataFrame, formal: DataFrame, foreign: DataFrame, protected: DataFrame) -> DataFrame:
    """(token, category, suggestion, accepted, candidates, foreign_word, foreign_score) of distinct tokens."""
    keys = tokens.select(T.casefold(F.col("token")).alias("token")).distinct()
    flagged = audit.flag_overlaps(keys, {
        "_formal": (F.col("token"), formal.select("word")), "_foreign": (F.col("token"), foreign.select("word")), "_protected": (F.col("token"), protected.select("word"))})
    flagged = flagged.withColumn("_protected", F.col("_protected") | F.col("token").rlike("(?U)\\d"))
    exact = F.when(F.col("_protected"), "protected").when(F.col("_formal") & F.col("_foreign"), "ambiguous_exact").when(F.col("_foreign"), "foreign_exact").when(F.col("_formal"), "formal_exact")
    flagged = flagged.withColumn("_exact", exact)
    open_ = flagged.filter("_exact is null").select("token")
    full = flagged.join(formal_candidates(open_, formal), "token", "left").join(nearest_foreign(open_, foreign), "token", "left")
    allowed = F.when(F.length("token") >= 4, MAX_RATIO).otherwise(min(SHORT_RATIO, MAX_RATIO))
    best, second = F.try_element_at("candidates", F.lit(1)), F.try_element_at("candidates", F.lit(2))
    no_formal = best.isNull() | (best["score"] > allowed)
    foreign_near = F.coalesce(F.col("foreign_score") <= best["score"] + FOREIGN_MARGIN, F.lit(False))
    category = (
        F.when(F.col("_exact").isNotNull(), F.col("_exact"))
        .when(no_formal & F.coalesce(F.col("foreign_score") <= allowed, F.lit(False)), "possible_foreign")
        .when(no_formal, "unresolved")
        .when(foreign_near & (F.col("foreign_score") + FOREIGN_MARGIN < best["score"]), "possible_foreign")
        .when(foreign_near, "ambiguous_near")
        .when(F.coalesce(second["score"] - best["score"] < MARGIN, F.lit(False)), "ambiguous_formal")
        .otherwise("informal")
    )
    out = full.withColumn("category", category)
    accepted = F.col("category") == "informal"
    return out.select("token", "category", F.when(accepted, best["word"]).otherwise(F.col("token")).alias("suggestion"), accepted.alias("accepted"), "candidates", "foreign_word", "foreign_score")


def classify(tokens: DataFrame, formal: DataFrame, foreign: DataFrame, reverse: DataFrame) -> DataFrame:
    """Five categories by membership in three word tables."""
    flagged = audit.flag_overlaps(tokens, {
        "_w": (F.col("token"), formal.select("word")), "_f": (F.col("token"), foreign.select("word")), "_r": (F.col("token"), reverse.select("src"))})
    category = (
        F.when(F.col("_w") & ~F.col("_f"), "formal").when(F.col("_f") & ~F.col("_w") & F.col("_r"), "foreign_substituted")
        .when(F.col("_f") & ~F.col("_w"), "foreign_native").when(F.col("_w") & F.col("_f"), "ambiguous_cognate").otherwise("informal"))
    return flagged.withColumn("category", category).drop("_w", "_f", "_r")


def formal_forms(tokens: DataFrame, formal: DataFrame) -> DataFrame:
    """(token, word, kind): reverse rules that hit the vocabulary first, then the
    nearest word to any candidate spelling, else the token itself."""
    spelled = tokens.select("token").distinct().select("token", F.explode(reverse_candidates(F.col("token"))).alias("candidate"))
    hits = spelled.join(formal.select(F.col("word").alias("candidate")).distinct(), "candidate").filter("candidate <> token")
    priced = hits.withColumn("_d", S.weighted_distance(F.col("token"), F.col("candidate"), S.REVERSE_PRICE, S.REVERSE_LETTERS))
    best = F.min_by("candidate", F.struct("_d", F.abs(F.length("candidate") - F.length("token")).alias("g"), "candidate"))
    direct = priced.groupBy("token").agg(best.alias("word")).withColumn("kind", F.lit("rule_exact"))
    rest = spelled.join(direct.select("token"), "token", "left_anti")
    near = fuzzy.best_match(rest.select(F.col("candidate").alias("token")), formal, 0.25, 1).filter("kind <> 'unmatched'").select(F.col("token").alias("candidate"), "word", "distance")
    joined = rest.join(near, "candidate")
    nearest = joined.groupBy("token").agg(F.min_by("word", F.struct("distance", F.abs(F.length("word") - F.length("token")).alias("g"), "word")).alias("word")).withColumn("kind", F.lit("distance"))
    found = direct.unionByName(nearest)
    return tokens.select("token").distinct().join(found, "token", "left").select("token", F.coalesce("word", "token").alias("word"), F.coalesce("kind", F.lit("unmatched")).alias("kind"))


def reverse_sentences(df: DataFrame, key: str, text: str, formal: DataFrame, foreign: DataFrame, reverse: DataFrame) -> DataFrame:
    """(key, restored): informal sentences mapped towards their formal form.

    Acronyms and numbers stay.  Decisions are made once a distinct token.
    """
    protected = "|".join(R.PROTECTED)
    words = df.select(key, F.posexplode(F.regexp_extract_all(T.blank(F.col(text)), F.lit(f"(?U)({protected}|\\w+(?:[-'\\u2019]\\w+)*)"), F.lit(1))).alias("at", "surface"))
    kept = F.col("surface").rlike(f"(?U)^(?:{protected})$")
    words = words.withColumn("token", F.when(kept, F.lit(None).cast("string")).otherwise(F.lower("surface")))
    distinct = words.select("token").filter("token is not null").distinct()
    labelled = classify(distinct, formal, foreign, reverse)
    forms = formal_forms(labelled.filter("category = 'informal'"), formal).select("token", "word")
    back = lexicon.best_translation(reverse).select(F.col("src").alias("token"), F.col("tgt").alias("_back"))
    decided = labelled.join(forms, "token", "left").join(back, "token", "left")
    chosen = F.when(F.col("category") == "informal", F.col("word")).when(F.col("category") == "foreign_substituted", F.coalesce("_back", "token")).otherwise(F.col("token"))
    decided = decided.select("token", chosen.alias("_out"))
    joined = words.join(decided, "token", "left").select(key, "at", F.coalesce("_out", "surface").alias("w"))
    return joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]), " ").alias("restored"))


def replace_words(text: Column, words: Column) -> Column:
    """Put new words into a text and keep its separators; the counts must agree."""
    pattern = "(?U)\\w+(?:[-'\\u2019]\\w+)*"
    gaps = F.split(text, pattern, -1)
    return F.array_join(F.flatten(F.zip_with(gaps, F.concat(words, F.array(F.lit(""))), lambda g, w: F.array(g, w))), "")
