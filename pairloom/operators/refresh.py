"""Automatic annotation rows: propagation, refresh and lexical features, all as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions import similarity as S
from ..functions import text as T
from . import annotation, order

#: Marks of automatic rows, and the names of the lookups.
AUTO, AUTO_LOOKUP, AUTO_NAME, AUTO_MAPPING = "AUTO_IDENTITY_", "AUTO_IDENTITY_LOOKUP", "AUTO_IDENTITY_NAME_LOOKUP", "AUTO_CONFIRMED_MAPPING_DEFAULT"
CURATED, SEED, FRENCH, NAMES, CONFIRMED = "curated_lookup", "seed_lookup", "french_seed_lookup", "name_seed_lookup", "confirmed_mapping_default"
DECISION = ["lemma", "pos", "source_language", "target_language", "entity_type", "protected", "error_type"]


def lookup_decision(prefix: str = "") -> dict[str, Column]:
    """Language, entity and protection that a lookup row stands for, by its source.

    Columns read: lookup_source, target_language, entity_type, protected.
    """
    c = lambda n: F.col(f"{prefix}{n}")
    source = c("lookup_source")
    language = F.when(source == NAMES, "unknown").when(source == FRENCH, "fr").when(source == SEED, "wo").otherwise(c("target_language"))
    entity = F.when(source == NAMES, "PERSON").when(source.isin(FRENCH, SEED), "UNKNOWN").otherwise(F.coalesce(F.nullif(F.trim(c("entity_type")), F.lit("")), F.lit("UNKNOWN")))
    protected = F.when(source.isin(NAMES, FRENCH), "yes").when(source == SEED, "no").otherwise(F.coalesce(F.nullif(F.trim(c("protected")), F.lit("")), F.lit("uncertain")))
    return {"source_language": language, "target_language": language, "entity_type": entity, "protected": protected}


def automatic_identities(occurrences: DataFrame, annotations: DataFrame, lookup: DataFrame) -> DataFrame:
    """Rows for unannotated tokens that equal their formal form and need no decision.

    ``lookup``: key, lemma, pos, lookup_source, review_status, target_language,
    entity_type, protected, ambiguous_pos, language_ambiguous.
    """
    open_ = occurrences.join(annotations.select("occurrence_id").distinct(), "occurrence_id", "left_anti")
    same = open_.filter(T.collapse(F.col("informal_token")) == T.collapse(F.col("formal_token"))).withColumn("key", T.lookup_key(F.col("formal_token"), None))
    found = same.join(lookup, "key")
    reviewed = (F.col("lookup_source") == CURATED) & (F.col("review_status") == "reviewed")
    person = (F.col("lookup_source") == CURATED) & (F.col("pos") == "PROPN") & (F.col("entity_type") == "PERSON") & (F.col("protected") == "yes")
    vague = F.coalesce("ambiguous_pos", F.lit(False)) | F.coalesce("language_ambiguous", F.lit(False)) | (F.col("pos") == "UNKNOWN")
    known = F.col("target_language").isin("wo", "fr") | (F.col("lookup_source") == NAMES) | person | reviewed
    safe = found.filter(F.col("pos").isin(*E.POS) & (reviewed | ~vague) & known)
    values = lookup_decision()
    values["source_language"] = values["target_language"] = F.when(person, "unknown").otherwise(values["source_language"])
    return safe.select(
        "occurrence_id", "source_index", "token_position", "informal_token", "formal_token", F.coalesce(F.nullif(F.trim("lemma"), F.lit("")), F.col("formal_token")).alias("lemma"), "pos",
        *[v.alias(k) for k, v in values.items()], F.lit("identity").alias("error_type"), F.lit("reviewed").alias("review_status"),
        F.when(F.col("lookup_source") == NAMES, AUTO_NAME).otherwise(AUTO_LOOKUP).alias("notes"), "lookup_source")


def automatic_mappings(occurrences: DataFrame, annotations: DataFrame, ordinal: str, fields: list[str]) -> DataFrame:
    """Rows for unannotated tokens whose exact mapping two or more reviewers agree on."""
    human = annotations.filter((F.col("review_status") == "reviewed") & ~T.blank(F.col("notes")).startswith("AUTO_"))
    keyed = human.withColumn("mapping", F.struct(T.collapse(F.col("informal_token")).alias("i"), T.collapse(F.col("formal_token")).alias("f")))
    agreed = annotation.confirmed_default(keyed, "mapping", fields, ordinal).drop("reviews")
    open_ = occurrences.join(annotations.select("occurrence_id").distinct(), "occurrence_id", "left_anti")
    open_ = open_.withColumn("mapping", F.struct(T.collapse(F.col("informal_token")).alias("i"), T.collapse(F.col("formal_token")).alias("f")))
    out = open_.join(agreed, "mapping").drop("mapping")
    return out.withColumns({
        "transformation_steps": S.edits(F.col("formal_token"), F.col("informal_token")), "review_status": F.lit("reviewed"), "notes": F.lit(AUTO_MAPPING), "lookup_source": F.lit(CONFIRMED)})


def classify_refresh(annotations: DataFrame, lookup: DataFrame, names: DataFrame) -> DataFrame:
    """``annotations`` plus ``refresh``: remove, modified or keep.

    ``lookup``: key, lookup_source, lemma, pos, target_language, entity_type,
    protected.  An automatic row is removed if a curated lookup can make it
    again, or if it is untouched and its key is stale (French, or a name now);
    an automatic row that differs from what its lookup says was modified by hand.
    """
    keyed = annotations.withColumn("_key", T.lookup_key(F.col("formal_token"), None))
    expected = lookup.select(
        F.col("key").alias("_key"), F.col("lookup_source").alias("_source"), F.struct(
            F.coalesce(F.nullif(F.trim("lemma"), F.lit("")), F.lit(None).cast("string")).alias("lemma"), F.col("pos").alias("pos"),
            *[v.alias(k) for k, v in lookup_decision().items()], F.lit("identity").alias("error_type")).alias("_want"))
    joined = keyed.withColumn("_source", F.col("lookup_source")).join(expected, ["_key", "_source"], "left")
    listed = names.select(F.col("key").alias("_key")).distinct().withColumn("_name", F.lit(True))
    joined = joined.join(listed, "_key", "left")
    lemma = F.coalesce(F.col("_want.lemma"), F.col("formal_token"))
    same = F.col("_want").isNotNull() & F.col("lemma").eqNullSafe(lemma)
    for c in DECISION[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_want.{c}"))
    auto = T.blank(F.col("notes")).startswith(AUTO)
    stale = (F.col("_source") == FRENCH) | F.coalesce("_name", F.lit(False))
    verdict = F.when(~auto, "keep").when((F.col("_source") == CURATED) | (same & stale), "remove").when(~same, "modified").otherwise("keep")
    return joined.withColumn("refresh", verdict).select(*annotations.columns, "refresh")


def complete_names(classified: DataFrame, names: DataFrame) -> DataFrame:
    """Automatic rows corrected to a proper noun of no language become whole name rows."""
    listed = names.select(F.col("key").alias("_key")).distinct().withColumn("_name", F.lit(True))
    joined = classified.withColumn("_key", T.lookup_key(F.col("formal_token"), None)).join(listed, "_key", "left")
    unknown = (F.lower("source_language") == "unknown") & (F.lower("target_language") == "unknown")
    due = (F.col("refresh") != "remove") & T.blank(F.col("notes")).startswith(AUTO) & F.coalesce("_name", F.lit(False)) & (F.col("pos") == "PROPN") & unknown
    made = annotation.set_columns_where(joined.withColumn("migrated", due), F.col("migrated"), {
        "source_language": F.lit("unknown"), "target_language": F.lit("unknown"), "entity_type": F.lit("PERSON"), "protected": F.lit("yes"), "lookup_source": F.lit(NAMES), "notes": F.lit(AUTO_NAME)})
    return made.drop("_key", "_name")


def feature_lookup(annotations: DataFrame, surnames: DataFrame) -> DataFrame:
    """(key, is_french, is_entity, is_protected) of word forms.

    Flags are the largest seen; a form that was ever corrected is not
    protected; surnames are entities and protected whatever else was seen.
    """
    french = (F.lower("source_language") == "fr") | (F.lower("target_language") == "fr")
    entity = ~F.lower(T.blank(F.col("entity_type"))).isin("", "unknown", "none", "o")
    protected = F.lower(T.blank(F.col("protected"))).isin("yes", "true", "1", "oui")
    same = T.casefold(F.trim("informal_token")) == T.casefold(F.trim("formal_token"))
    side = lambda c, safe, editable: F.struct(T.token_edges(F.col(c)).alias("key"), french.alias("f"), entity.alias("e"), (protected & safe).alias("p"), editable.alias("x"))
    both = annotations.select(F.explode(F.array(side("informal_token", same, ~same), side("formal_token", F.lit(True), F.lit(False)))).alias("s")).select("s.*")
    seen = both.filter((F.col("key") != "") & ~F.col("key").rlike("(?U)\\s")).groupBy("key").agg(*[F.max(c).alias(c) for c in "fepx"])
    known = surnames.select(T.token_edges(F.col("value")).alias("key")).filter("key <> ''").distinct().withColumn("_s", F.lit(True))
    joined = seen.join(known, "key", "full_outer")
    surname = F.coalesce("_s", F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return joined.select(
        "key", flag(F.col("f")).alias("is_french"), (flag(F.col("e")) | surname).alias("is_entity"), ((flag(F.col("p")) & ~flag(F.col("x"))) | surname).alias("is_protected"))


def word_features(texts: DataFrame, key: str, text: str, features: DataFrame) -> DataFrame:
    """(key, position, word, flags) of every word of a text."""
    words = texts.select(key, F.posexplode(F.filter(F.split(T.collapse(F.col(text)), " "), lambda w: w != "")).alias("position", "word")).withColumn("_k", T.token_edges(F.col("word")))
    joined = words.join(features.withColumnRenamed("key", "_k"), "_k", "left").drop("_k")
    return joined.na.fill(False, ["is_french", "is_entity", "is_protected"])


def split_review(rows: DataFrame, payload: str, manual: str) -> DataFrame:
    """Rows whose token payload no longer reads as their sentence."""
    rebuilt = rows.withColumn("reconstructed", T.reconstruct(F.col(payload)))
    return rebuilt.filter(T.collapse(F.col("reconstructed")) != T.collapse(F.col(manual)))


def save_problems() -> Column:
    """Why an annotation row may not be saved; empty if it may."""
    from .audit import reject_reasons

    ok = lambda c, enum: F.coalesce(F.col(c).isin(*enum), F.lit(False))
    return reject_reasons(
        ("pos", ~ok("pos", E.POS)), ("source_language", ~ok("source_language", E.LANGUAGES)), ("target_language", ~ok("target_language", E.LANGUAGES)),
        ("entity_type", ~ok("entity_type", E.ENTITIES)), ("protected", ~ok("protected", E.PROTECTED)), ("error_type", ~ok("error_type", E.ERROR_TYPES)),
        ("review_status", ~ok("review_status", ("reviewed", "uncertain"))), ("lemma", F.trim(T.blank(F.col("lemma"))) == ""),
        ("identity_mismatch", (F.col("error_type") == "identity") & (T.collapse(F.col("informal_token")) != T.collapse(F.col("formal_token")))))


def latest_annotations(log: DataFrame, ordinal: str) -> DataFrame:
    return order.keep_last(log, ["occurrence_id"], [ordinal])
