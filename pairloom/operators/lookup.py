"""Lookup tables of words, names and languages, and what annotation rows take from them.

All lookups share one shape: key, formal_token, lemma, pos, target_language,
entity_type, protected, review_status, lookup_source, languages (array),
language_ambiguous, entry_count, ambiguous_pos, pos_candidates (array),
pos_by_language (map), lemmas (array).  A key has one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions import text as T
from . import annotation, audit
from .refresh import FRENCH, NAMES, SEED

AMBIGUOUS = "ambiguous_language_seed_lookup"
COLUMNS = [
    "key", "formal_token", "lemma", "pos", "target_language", "entity_type", "protected", "review_status", "lookup_source", "languages", "language_ambiguous",
    "entry_count", "ambiguous_pos", "pos_candidates", "pos_by_language", "lemmas",
]
_NO_MAP = "cast(map() as map<string,array<string>>)"


def first_column(df: DataFrame, names: list[str]) -> str | None:
    """The first column of ``df`` that is one of ``names``."""
    return next((c for c in df.columns if c in names), None)


def single_words(words: Column) -> Column:
    """The casefolded word if it is one token of the word pattern, else null."""
    folded = T.casefold(T.collapse(words))
    return F.when(folded.rlike("(?U)^\\w+(?:[-'\\u2019]\\w+)*$"), folded)


def word_metadata(words: DataFrame, word: str, pos: str, definition: str, ordinal: str, tags: int = 4, texts: int = 3) -> DataFrame:
    """(word, pos, definition): the first sorted tags and the first distinct definitions of single-token headwords."""
    rows = words.select(single_words(F.col(word)).alias("word"), T.collapse(F.col(pos)).alias("p"), T.collapse(F.col(definition)).alias("d"), F.col(ordinal).alias("o")).filter("word is not null")
    distinct = rows.groupBy("word", "d").agg(F.min("o").alias("o"), F.collect_set("p").alias("p"))
    by = distinct.groupBy("word").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("p"), F.array_sort(F.collect_list(F.struct("o", "d"))).alias("d"))
    full = lambda a: F.filter(a, lambda x: x != "")
    return by.select(
        "word", F.array_join(F.slice(full(F.col("p")), 1, tags), " / ").alias("pos"),
        F.array_join(F.slice(full(F.transform("d", lambda x: x["d"])), 1, texts), "; ").alias("definition"))


def formal_units(rows: DataFrame, payload: str, ordinal: str) -> DataFrame:
    """(key, formal_token): first surface of every formal token of JSON payloads."""
    each = rows.select(F.col(ordinal).alias("o"), F.posexplode(F.from_json(payload, annotation.TOKEN)).alias("at", "t"))
    chosen = F.coalesce(*[F.nullif(T.collapse(F.col(f"t.{c}")), F.lit("")) for c in ("final_correction", "selected_candidate", "token")])
    named = each.select("o", "at", chosen.alias("formal_token")).filter("formal_token is not null").withColumn("key", T.casefold(F.col("formal_token")))
    return named.groupBy("key").agg(F.min_by("formal_token", F.struct("o", "at")).alias("formal_token"))


def _row(language: str, entity: str, protected: str, source: str) -> dict[str, Column]:
    return {
        "target_language": F.lit(language), "entity_type": F.lit(entity), "protected": F.lit(protected), "review_status": F.lit("reviewed"), "lookup_source": F.lit(source),
        "languages": F.array(F.lit(language)), "language_ambiguous": F.lit(False)}


def dictionary_seed(entries: DataFrame, word: str, tag: str, lemma: str | None, ordinal: str, tags: dict[str, str], language: str, protected: str, source: str) -> DataFrame:
    """A dictionary's lookup: first surface, mapped tags as candidates, one tag or UNKNOWN,
    one lemma or the surface itself."""
    mapped = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in tags.items() for x in p]), F.col("p")), F.lit("UNKNOWN"))
    rows = entries.select(
        T.collapse(F.col(word)).alias("w"), T.collapse(F.col(tag)).alias("p"), (F.lit("") if lemma is None else T.collapse(F.col(lemma))).alias("l"), F.col(ordinal).alias("o"))
    rows = rows.withColumns({"key": T.casefold(F.col("w")), "p": mapped}).filter("key <> ''")
    lemmas = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("l") != "", F.struct("o", "l")))), lambda x: x["l"]))
    candidates = F.array_sort(F.collect_set(F.when(F.col("p") != "UNKNOWN", F.col("p"))))
    by = rows.groupBy("key").agg(F.min_by("w", "o").alias("formal_token"), F.count(F.lit(1)).cast("long").alias("entry_count"), candidates.alias("pos_candidates"), lemmas.alias("lemmas"))
    one = lambda a, other: F.when(F.size(a) == 1, F.element_at(a, 1)).otherwise(other)
    return by.withColumns({
        "lemma": one("lemmas", F.col("formal_token")), "pos": one("pos_candidates", F.lit("UNKNOWN")), "ambiguous_pos": F.size("pos_candidates") > 1,
        "pos_by_language": F.expr(_NO_MAP), **_row(language, "UNKNOWN", protected, source)}).select(*COLUMNS)


def name_seed(names: DataFrame, name: str, ordinal: str) -> DataFrame:
    """Person names: proper nouns of no language, first spelling."""
    rows = names.select(T.collapse(F.col(name)).alias("w"), F.col(ordinal).alias("o")).withColumn("key", T.casefold(F.col("w"))).filter("key <> ''")
    by = rows.groupBy("key").agg(F.min_by("w", "o").alias("formal_token"))
    noun = F.lit("PROPN")
    return by.withColumns({
        "lemma": F.col("formal_token"), "pos": noun, "entry_count": F.lit(1).cast("long"), "ambiguous_pos": F.lit(False), "pos_candidates": F.array(noun),
        "pos_by_language": F.expr(_NO_MAP), "lemmas": F.array("formal_token"), **_row("unknown", "PERSON", "yes", NAMES)}).select(*COLUMNS)


def multilingual_seed(own: DataFrame, foreign: DataFrame, names: DataFrame, units: DataFrame, codes: tuple[str, str] = ("wo", "fr")) -> DataFrame:
    """One lookup of three: names win, then words of both languages (marked as
    ambiguous), then words of one.  Foreign words count only where ``units`` has them."""
    free = lambda df: df.join(names.select("key"), "key", "left_anti")
    named = foreign.drop("formal_token").join(units.select("key", "formal_token"), "key")
    # without a lemma of its own a foreign word stands for itself as the corpus writes it
    named = named.withColumn("lemma", F.when(F.size("lemmas") == 1, F.element_at("lemmas", 1)).otherwise(F.col("formal_token"))).select(*COLUMNS)
    a, b = (df.select("key", F.struct(*COLUMNS).alias(side)) for df, side in ((free(own), "a"), (free(named), "b")))
    both = a.join(b, "key", "full_outer")
    tags = F.array_sort(F.array_union("a.pos_candidates", "b.pos_candidates"))
    made = {
        "key": F.col("key"), "formal_token": F.col("a.formal_token"), "lemma": F.col("a.formal_token"), "pos": F.when(F.size(tags) == 1, F.element_at(tags, 1)).otherwise("UNKNOWN"),
        "target_language": F.lit("unknown"), "entity_type": F.lit("UNKNOWN"), "protected": F.lit("uncertain"), "review_status": F.lit("uncertain"), "lookup_source": F.lit(AMBIGUOUS),
        "languages": F.array(*map(F.lit, codes)), "language_ambiguous": F.lit(True), "entry_count": F.col("a.entry_count") + F.col("b.entry_count"), "ambiguous_pos": F.size(tags) > 1,
        "pos_candidates": tags, "pos_by_language": F.create_map(F.lit(codes[0]), F.col("a.pos_candidates"), F.lit(codes[1]), F.col("b.pos_candidates")),
        "lemmas": F.array_union("a.lemmas", "b.lemmas")}
    merged = F.struct(*[made[c].alias(c) for c in COLUMNS])
    chosen = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(merged)
    return audit.require_unique(names.select(*COLUMNS).unionByName(both.select(chosen.alias("r")).select("r.*")), ["key"], "headwords")


def seed_statistics(seed: DataFrame, units: DataFrame) -> DataFrame:
    """One row: entries by origin, all entries, units, and units that the lookup covers."""
    covered = units.select("key").distinct().join(seed.select("key", F.lit(True).alias("_in")), "key", "left").agg(F.count(F.lit(1)).alias("units"), F.count("_in").alias("covered"))
    counts = seed.agg(F.count(F.lit(1)).alias("entries"), *[F.count_if(F.col("lookup_source") == s).alias(n) for n, s in (("own", SEED), ("foreign", FRENCH), ("names", NAMES), ("ambiguous", AMBIGUOUS))])
    return counts.withColumn("_k", F.lit(1)).join(covered.withColumn("_k", F.lit(1)), "_k").drop("_k")


def pos_options(pos: Column, candidates: Column, ambiguous: Column) -> Column:
    """The tags that an annotator may choose: the lookup's own, its candidates if it
    leaves the choice open, else all.  ``pos`` is null without a lookup."""
    every = F.array(*map(F.lit, E.POS))
    known = annotation.canonical_order(F.coalesce(candidates, F.array().cast("array<string>")), list(E.POS))
    open_ = (F.coalesce(ambiguous, F.lit(False)) | (pos == "UNKNOWN")) & (F.size(known) > 0)
    return F.when(pos.isNull(), every).when(open_, F.array_union(F.array(F.lit("UNKNOWN")), known)).when(pos.isin(*E.POS[1:]), F.array(pos)).otherwise(every)


def prefilled(occurrences: DataFrame, lookup: DataFrame) -> DataFrame:
    """``occurrences`` (informal_token, formal_token) with suggested values, allowed tags and locks.

    Error types come from the pair; a lookup fixes language, entity and
    protection by its source; changed foreign words are foreign spellings.
    """
    found = lookup.select(F.col("key").alias("_key"), F.struct(*[c for c in COLUMNS if c != "key"]).alias("_l"))
    joined = occurrences.withColumn("_key", T.lookup_key(F.col("formal_token"), None)).join(found, "_key", "left")
    got = lambda c: F.col(f"_l.{c}")
    source, none = got("lookup_source"), F.col("_l").isNull()
    by_source = lambda table, other: F.coalesce(*[F.when(source == s, F.lit(v)) for s, v in table.items()], other)
    language = by_source({NAMES: "unknown", FRENCH: "fr", SEED: "wo", AMBIGUOUS: "unknown"}, F.coalesce(got("target_language"), F.lit("unknown")))
    formal = T.collapse(F.col("formal_token"))
    same = T.collapse(F.col("informal_token")) == formal
    types = E.error_types(F.col("informal_token"), F.col("formal_token"))
    spelled = F.when((language == "fr") & ~same, annotation.canonical_order(F.array_union("_t", F.array(F.lit("french_spelling"))), list(E.ERROR_TYPES))).otherwise(F.col("_t"))
    loose = F.coalesce(got("ambiguous_pos"), F.lit(False)) | F.coalesce(got("language_ambiguous"), F.lit(False))
    seed_loose = ~none & (source != "curated_lookup") & loose
    editable = none | (got("pos") == "UNKNOWN") | F.coalesce(got("ambiguous_pos"), F.lit(False))
    either = none | F.coalesce(got("language_ambiguous"), F.lit(False))
    return joined.withColumn("_t", types).select(
        *occurrences.columns, F.coalesce(got("lemma"), F.when(~formal.contains(" "), formal), F.lit("")).alias("lemma"),
        by_source({NAMES: "PROPN"}, F.coalesce(got("pos"), F.lit("UNKNOWN"))).alias("pos"), language.alias("source_language"), language.alias("target_language"),
        by_source({NAMES: "PERSON", FRENCH: "UNKNOWN", SEED: "UNKNOWN", AMBIGUOUS: "UNKNOWN"}, F.coalesce(got("entity_type"), F.lit("UNKNOWN"))).alias("entity_type"),
        by_source({NAMES: "yes", FRENCH: "yes", SEED: "no", AMBIGUOUS: "uncertain"}, F.coalesce(got("protected"), F.lit("uncertain"))).alias("protected"),
        spelled.alias("error_types"), F.when(F.coalesce(source == AMBIGUOUS, F.lit(False)), "uncertain").otherwise("reviewed").alias("review_status"), F.coalesce(source, F.lit("none")).alias("lookup_source"),
        (~seed_loose & ~(~none & ~editable)).alias("reusable"), pos_options(got("pos"), got("pos_candidates"), got("ambiguous_pos")).alias("pos_options"), editable.alias("pos_editable"),
        none.alias("lemma_editable"), either.alias("language_editable"), either.alias("entity_editable"), ((same & ~none & ~loose) | (language == "fr") & ~none | F.coalesce(source == NAMES, F.lit(False))).alias("source_language_locked"))


def save_rules(submitted: DataFrame, lookup: DataFrame) -> DataFrame:
    """``submitted`` (informal_token, formal_token, pos, target_language, entity_type,
    error_types) plus ``problems``: which rules of pair and lookup it breaks."""
    found = lookup.select(F.col("key").alias("_key"), "pos_candidates", "pos_by_language", "languages", "lookup_source", F.col("pos").alias("_pos"), "ambiguous_pos")
    joined = submitted.withColumn("_key", T.lookup_key(F.col("formal_token"), None)).join(found.withColumnRenamed("lookup_source", "_source"), "_key", "left")
    types, same = F.col("error_types"), T.collapse(F.col("informal_token")) == T.collapse(F.col("formal_token"))
    options = pos_options(F.col("_pos"), F.col("pos_candidates"), F.col("ambiguous_pos"))
    ambiguous = F.coalesce(F.col("_source") == AMBIGUOUS, F.lit(False))
    own = F.coalesce(F.try_element_at("pos_by_language", F.col("target_language")), F.array().cast("array<string>"))
    problems = audit.reject_reasons(
        ("error_types", F.exists(types, lambda t: ~t.isin(*E.ERROR_TYPES)) | (F.size(types) == 0)),
        ("identity_combined", F.array_contains(types, "identity") & (F.size(types) > 1)), ("identity_on_change", F.array_contains(types, "identity") & ~same),
        ("identity_missing", same & ~F.array_contains(types, "identity")), ("pos_not_allowed", ~F.array_contains(options, F.col("pos"))),
        ("person_needs_propn", (F.col("entity_type") == "PERSON") & ~F.array_contains(options, "PROPN")),
        ("language_not_candidate", ambiguous & ~F.array_contains("languages", F.col("target_language"))),
        ("pos_of_other_language", ambiguous & (F.col("pos") != "UNKNOWN") & (F.size(own) > 0) & ~F.array_contains(own, F.col("pos"))))
    return joined.withColumn("problems", problems).select(*submitted.columns, "problems")


def modes_of_words(annotations: DataFrame, fields: list[str], tokens: tuple[str, ...] = ("informal_token", "formal_token"), otherwise: str = "unknown") -> DataFrame:
    """(key, fields): over each token column the most frequent value, and of those the most
    frequent; ties give the smallest.  Reviewed rows only, if there are any."""
    reviewed = annotations.filter("review_status = 'reviewed'")
    rows = reviewed if reviewed.limit(1).count() else annotations
    value = lambda c: F.nullif(F.trim(T.blank(F.col(c))), F.lit(""))
    mode = lambda c: F.coalesce(F.mode(F.col(c), True), F.lit(otherwise)).alias(c)
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(t).alias("side"), T.token_edges(F.col(t)).alias("key")) for t in tokens])).alias("x"), *[value(c).alias(c) for c in fields])
    sides = each.filter("x.key <> ''").groupBy("x.side", "x.key").agg(*map(mode, fields))
    return sides.groupBy("key").agg(*map(mode, fields))
