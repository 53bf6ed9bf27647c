"""Blocked fuzzy joins between token tables.

No blocking here is a cross join: pairs meet on equal segments (of a bounded
distance, one of the word's ``limit + 1`` segments must stand in the token, near
its own place), on an equal length where no bound is known, or on a shared
signature or n-gram, and cheap built-in distances with a limit cut the pairs
before any Arrow function sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from . import audit, order, overlap


def _segment_pairs(tokens: DataFrame, words: DataFrame, band: int, limit: Column) -> DataFrame:
    """(token, word, _a, _b) of the pairs that share a segment.

    ``tokens``: token, _a; ``words``: word, _b; segments are taken of ``_a`` and
    ``_b``.  ``limit`` is the largest distance of the two, an expression over
    their lengths ``_n`` (token) and ``_m`` (word).  A word of ``_m`` characters is
    cut into limit + 1 parts; a pair within the limit shares a part whose places
    in both differ by at most the limit.
    """
    k = limit.cast("int")
    i = F.col("_i")
    start, end = F.floor(F.col("_m") * i / (k + 1)).cast("int"), F.floor(F.col("_m") * (i + 1) / (k + 1)).cast("int")
    lengths = lambda n: F.explode(F.sequence(F.greatest(n - band, F.lit(0)), n + band))
    w = words.withColumn("_m", F.length("_b")).withColumn("_n", lengths(F.col("_m"))).withColumn("_i", F.explode(F.sequence(F.lit(0), k)))
    w = w.select("word", "_b", "_m", "_n", "_i", F.substring(F.col("_b"), start + 1, end - start).alias("_part"))
    t = tokens.withColumn("_n", F.length("_a")).withColumn("_m", lengths(F.col("_n"))).withColumn("_i", F.explode(F.sequence(F.lit(0), k)))
    shifts = F.sequence(F.greatest(start - k, F.lit(0)), F.least(start + k, F.greatest(F.col("_n") - (end - start), F.lit(0))))
    at = F.when(F.greatest(start - k, F.lit(0)) <= F.least(start + k, F.greatest(F.col("_n") - (end - start), F.lit(0))), shifts)
    parts = F.array_distinct(F.transform(at, lambda p: F.substring(F.col("_a"), p + 1, end - start)))
    t = t.select("token", "_a", "_m", "_n", "_i", F.explode(parts).alias("_part"))
    return t.join(w, ["_m", "_n", "_i", "_part"]).select("token", "word", "_a", "_b").distinct()


def band_join(tokens: DataFrame, words: DataFrame, band: int = 2, limit: int | None = None, ratio: float | None = None) -> DataFrame:
    """(token, word, distance): words whose length differs by at most ``band``.

    ``limit`` is the largest plain distance to keep, ``ratio`` the largest share
    of the longer length; with either, pairs meet on equal segments only, and
    the built-in distance stops early.  Without, they meet on lengths.
    """
    t, w = tokens.select("token").distinct(), words.select("word").distinct()
    if limit is None and ratio is None:
        near = t.withColumn("_n", F.explode(F.sequence(F.greatest(F.length("token") - band, F.lit(1)), F.length("token") + band)))
        return near.join(w.withColumn("_n", F.length("word")), "_n").select("token", "word", F.levenshtein("token", "word").alias("distance"))
    most = F.lit(limit) if ratio is None else F.floor(F.greatest("_n", "_m") * F.lit(ratio) + F.lit(1e-9))
    most = most if limit is None or ratio is None else F.least(most, F.lit(limit))
    pairs = _segment_pairs(t.withColumn("_a", F.col("token")), w.withColumn("_b", F.col("word")), band, most).select("token", "word")
    out = pairs.select("token", "word", (F.levenshtein("token", "word") if limit is None else F.levenshtein("token", "word", limit)).alias("distance"))
    out = out.filter("distance >= 0")  # -1 means beyond the limit
    return out if ratio is None else out.filter(F.col("distance") / F.greatest(F.length("token"), F.length("word"), F.lit(1)) <= ratio)


def folded(text: Column, letters: tuple[tuple[str, str], ...]) -> Column:
    """The text with every letter of a near pair as the first letter of its chain: plain
    distances between folded texts are never above the weighted ones."""
    first: dict[str, str] = {}
    for a, b in letters:
        first[b] = first.get(a, a)
    return F.translate(text, "".join(first), "".join(first.values()))


def best_match(tokens: DataFrame, words: DataFrame, max_ratio: float = 0.34, band: int = 2, price: float = S.REVERSE_PRICE) -> DataFrame:
    """(token, word, distance, kind): exact match first, else the nearest word by
    weighted distance within ``max_ratio`` of the longer length.

    Ties: distance, length gap, word.
    """
    vocabulary = words.select("word").distinct()
    exact = tokens.select("token").distinct().join(vocabulary, F.col("token") == F.col("word"), "left")
    hit = exact.filter("word is not null").select("token", "word", F.lit(0.0).alias("distance"), F.lit("exact").alias("kind"))
    rest = exact.filter("word is null").select("token")
    most = F.floor(F.greatest("_n", "_m") * F.lit(max_ratio) + F.lit(1e-9))
    fold = lambda c: folded(F.col(c), S.REVERSE_LETTERS)
    pairs = _segment_pairs(rest.withColumn("_a", fold("token")), vocabulary.withColumn("_b", fold("word")), band, most)
    pairs = pairs.filter(F.levenshtein("_a", "_b") / F.greatest(F.length("token"), F.length("word"), F.lit(1)) <= max_ratio)
    priced = pairs.select("token", "word", S.weighted_distance(F.col("token"), F.col("word"), price, S.REVERSE_LETTERS).alias("distance"))
    priced = priced.filter(F.col("distance") / F.greatest(F.length("token"), F.length("word"), F.lit(1)) <= max_ratio)
    best = F.min_by(F.struct("word", "distance"), F.struct("distance", F.abs(F.length("token") - F.length("word")).alias("gap"), "word"))
    found = priced.groupBy("token").agg(best.alias("_b")).select("token", "_b.word", "_b.distance", F.lit("distance").alias("kind"))
    missed = rest.join(found, "token", "left_anti").select("token", F.lit(None).cast("string").alias("word"), F.lit(None).cast("double").alias("distance"), F.lit("unmatched").alias("kind"))
    return hit.unionByName(found).unionByName(missed)


def _signed(words: DataFrame, name: str, form: str | None) -> DataFrame:
    """Distinct words with signature ``_s`` and its n-grams as 64-bit ``elements``."""
    signed = words.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("_s", T.signature(F.col(name), form))
    return signed.withColumn("elements", F.transform(T.character_ngrams(F.col("_s")), lambda g: F.xxhash64(g)))


def _candidate_lists(tokens: DataFrame, words: DataFrame, pool: int, gap: int) -> DataFrame:
    """(token, candidates): an array of ``wid``; of signed tokens and of signed words with a dense ``wid``."""
    best = overlap.top_overlaps(tokens.select("token", "elements", F.length("token").alias("size")), words.select("wid", "elements", F.length("word").alias("size")), 2 * pool, gap)
    # no more are wanted, whatever the signature has; cut before the joins shuffle them
    best = best.select("token", F.slice("near", 1, pool).alias("near"))
    # the first words of a signature are enough, so a signature's tokens never meet all its words
    named = order.top_per_group(words.select("_s", "word", "wid"), ["_s"], [F.col("word")], pool)
    same = tokens.join(named, "_s").groupBy("token").agg(F.sort_array(F.collect_list("wid")).alias("same"))
    both = tokens.select("token").join(best, "token", "left").join(same, "token", "left")
    none = F.array().cast("array<int>")
    rest = F.array_except(F.coalesce("near", none), F.coalesce("same", none))
    first = F.coalesce("same", none)
    return both.select("token", F.concat(first, F.slice(rest, F.lit(1), F.greatest(F.lit(pool) - F.size(first), F.lit(0)))).alias("candidates")).filter(F.size("candidates") > 0)


def _numbered(words: DataFrame, form: str | None) -> DataFrame:
    """Signed words with ``wid``, dense in the order of the words."""
    from ..sources.shared import cut

    return cut(order.ranked_within(_signed(words, "word", form), F.lit(""), ["word"]).withColumnRenamed("_rank", "wid").drop("_first"))


def signature_candidates(tokens: DataFrame, words: DataFrame, pool: int = 200, gap: int = 3, form: str | None = "NFKC") -> DataFrame:
    """(token, word): words with the same signature, or sharing most signature
    n-grams: the ``2 * pool`` best by shared n-grams, of these the length gap, of these ``pool``.

    The best are found in cells of the two tables (``overlap``); pairs that only
    share an n-gram are never rows.
    """
    numbered = _numbered(words, form)
    lists = _candidate_lists(_signed(tokens, "token", form), numbered, pool, gap)
    return lists.select("token", F.explode("candidates").alias("wid")).join(numbered.select("wid", "word"), "wid").select("token", "word")


#: Weights and thresholds of variant mining.
WEIGHTS = {"char": 0.40, "rule": 0.30, "context": 0.20, "frequency": 0.10}
MIN_CHAR, MIN_SCORE, MIN_MARGIN = 0.50, 0.68, 0.03


def score_candidates(pairs: DataFrame, form: str | None = "NFKC") -> DataFrame:
    """``pairs`` (token, word, context_similarity, frequency_score) plus the parts and the score."""
    scored = pairs.withColumn("char_similarity", S.similarity(F.col("token"), F.col("word"))).withColumn(
        "rule_similarity", S.similarity(T.signature(F.col("token"), form), T.signature(F.col("word"), form)))
    total = (
        WEIGHTS["char"] * F.col("char_similarity") + WEIGHTS["rule"] * F.col("rule_similarity")
        + WEIGHTS["context"] * F.col("context_similarity") + WEIGHTS["frequency"] * F.col("frequency_score"))
    return scored.withColumn("score", total)


PARTS = ("char_similarity", "rule_similarity", "context_similarity", "frequency_score")


def rank_candidates(scored: DataFrame) -> DataFrame:
    """Best word of each token, the margin to the second, and the verdict."""
    two = scored.groupBy("token").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("score", "word", *PARTS)), asc=False), 1, 2).alias("_t"), F.count(F.lit(1)).alias("candidate_count"))
    return _verdicts(two)


def _verdicts(two: DataFrame) -> DataFrame:
    """As above, from the two best candidates ``_t`` and their number."""
    best, second = F.col("_t")[0], F.coalesce(F.try_element_at("_t", F.lit(2))["score"], F.lit(0.0))
    out = two.select(
        "token", best["word"].alias("word"), best["score"].alias("score"), second.alias("second_score"),
        F.when(F.col("candidate_count") > 1, best["score"] - second).otherwise(best["score"]).alias("margin"),
        *[best[c].alias(c) for c in PARTS], "candidate_count")
    return out.withColumn("reason", audit.first_reason(
        ("low_character_similarity", F.col("char_similarity") < MIN_CHAR), ("low_score", F.col("score") < MIN_SCORE), ("ambiguous_margin", F.col("margin") < MIN_MARGIN)))


def _two_best(found: DataFrame) -> DataFrame:
    """(token, _t, candidate_count) of rows token, _s, frequency_score, found: scored where they
    stand, so only two candidates of a token and word block are shuffled."""
    def scored(x: Column) -> Column:
        char, rule = S.similarity(F.col("token"), x["word"]), S.similarity(F.col("_s"), x["form"])
        total = WEIGHTS["char"] * char + WEIGHTS["rule"] * rule + WEIGHTS["context"] * x["similarity"] + WEIGHTS["frequency"] * F.col("frequency_score")
        return F.struct(total.alias("score"), x["word"].alias("word"), char.alias("char_similarity"), rule.alias("rule_similarity"), x["similarity"].alias("context_similarity"), F.col("frequency_score"))

    two = found.select("token", F.slice(F.sort_array(F.transform("found", scored), asc=False), 1, 2).alias("_t"), F.size("found").alias("_n"))
    return two.groupBy("token").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("_t")), asc=False), 1, 2).alias("_t"), F.sum("_n").alias("candidate_count"))


def _bags(contexts: DataFrame) -> DataFrame:
    """(token, keys, counts) of bags (token, context, count), sorted by the context's 64-bit key."""
    bag = contexts.groupBy("token").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("context").alias("k"), F.col("count").alias("n")))).alias("b"))
    return bag.select("token", F.transform("b", lambda x: x["k"]).alias("keys"), F.transform("b", lambda x: x["n"]).alias("counts"))


def mining_eligibility(token: Column, is_french: Column, is_entity: Column, shortest: int = 3, longest: int = 30) -> Column:
    """First reason that keeps a token out of mining, or ``eligible``."""
    return audit.first_reason(
        ("too_short", F.length(token) < shortest), ("too_long", F.length(token) > longest), ("likely_french", is_french),
        ("likely_entity_by_capitalization", is_entity), ("excessive_repetition", token.rlike("(.)\\1{3,}")), otherwise="eligible")


def mine_variants(comments: DataFrame, sentences: DataFrame, formal: DataFrame, french: DataFrame, protected: DataFrame | None = None,
                  min_frequency: int = 5, window: int = 2, top: int = 50, pool: int = 200) -> DataFrame:
    """Ranked formal candidate of every frequent out-of-vocabulary token.

    ``comments`` and ``sentences`` have text; ``formal`` and ``french`` have
    word.  Everything runs on distinct tokens; texts are read twice.
    """
    from ..sources.shared import cut
    from . import lexicon

    words = lambda df: T.tokens(T.unicode_form(df["text"], "NFKC"), "alpha")
    vocabulary = formal.select(T.casefold(F.trim("word")).alias("word")).filter("word <> ''").distinct()
    other = french.select(T.casefold(F.trim("word")).alias("word")).distinct()
    counts = lexicon.term_counts(comments, words(comments))
    counts = cut(counts)
    biggest = counts.agg(F.max("count")).first()[0] or 1
    oov = counts.join(vocabulary, counts["token"] == vocabulary["word"], "left_anti").filter(F.col("count") >= min_frequency)
    flags = {"_french": (F.col("token"), other)}
    if protected is not None:
        flags["_entity"] = (F.col("token"), protected.select("token"))
    oov = audit.flag_overlaps(oov, flags)
    oov = oov if protected is not None else oov.withColumn("_entity", F.lit(False))
    oov = oov.withColumn("reason", mining_eligibility(F.col("token"), F.col("_french"), F.col("_entity")))
    oov = cut(oov.withColumn("frequency_score", F.log1p("count") / F.log1p(F.lit(biggest))))
    signed = cut(_signed(oov.filter("reason = 'eligible'").select("token"), "token", "NFKC"))
    numbered = _numbered(vocabulary.join(other, "word", "left_anti"), "NFKC")
    lists = cut(_candidate_lists(signed, numbered, pool, 3))
    tasks = lexicon.near_tasks(oov.filter("reason = 'eligible'"), window)
    left = _bags(lexicon.contexts(comments, words(comments), lists.select("token"), window, top, tasks=tasks))
    right = _bags(lexicon.contexts(sentences, words(sentences), numbered.select(F.col("word").alias("token")), window, top))
    none = F.array().cast("array<bigint>")
    filled = [F.coalesce(c, none).alias(c) for c in ("keys", "counts")]
    tokens = lists.join(left, "token", "left").join(signed.select("token", "_s"), "token").join(oov.select("token", "frequency_score"), "token")
    tokens = cut(tokens.select("token", "_s", "frequency_score", "candidates", *filled))
    found = overlap.bag_scores(tokens, cut(numbered.join(right, numbered["word"] == right["token"], "left").select("wid", "word", F.col("_s").alias("form"), *filled)), ("_s", "frequency_score"))
    ranked = _verdicts(_two_best(found)).drop("frequency_score").withColumnRenamed("reason", "_verdict")
    out = oov.select("token", F.col("count").alias("frequency"), "frequency_score", "reason").join(ranked, "token", "left")
    reason = F.when(F.col("reason") != "eligible", F.col("reason")).otherwise(F.coalesce("_verdict", F.lit("no_candidate")))
    return out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "accepted", "accepted").otherwise("rejected")).drop("_verdict")
