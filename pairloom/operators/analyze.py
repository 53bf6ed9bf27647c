"""Analysis of whole sentences: suggestions, learned corrections and the automatic sentence as one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import suggest

#: Categories in which neither a lookup nor memory may change a token, and most suggestions shown.
GUARDED = ("protected", "foreign_exact", "ambiguous_exact", "possible_foreign", "ambiguous_near")
SHOWN = 8
_WORDS = "(?U)(\\w+(?:[-'\\u2019]\\w+)*)"


def analyze(df: DataFrame, key: str, text: str, formal: DataFrame, foreign: DataFrame, protected: DataFrame, learned: DataFrame) -> DataFrame:
    """(key, position, token, category, auto, suggestions, learned, changed, accepted, review_required).

    ``learned``: key, equivalents (newest first).  Decisions are made once a
    distinct token and joined back to the positions.
    """
    tokens = df.select(key, F.posexplode(F.regexp_extract_all(T.blank(F.col(text)), F.lit(_WORDS), F.lit(1))).alias("position", "token"))
    tokens = tokens.withColumn("_t", T.casefold(F.col("token")))
    decided = suggest.suggest(tokens.select(F.col("_t").alias("token")), formal, foreign, protected).withColumnRenamed("token", "_t")
    memory = learned.select(F.col("key").alias("_t"), F.col("equivalents").alias("_m"))
    rows = tokens.join(decided, "_t", "left").join(memory, "_t", "left").withColumn("_m", F.coalesce("_m", F.array().cast("array<string>")))
    shout = (F.length("token") > 1) & (F.upper("token") == F.col("token")) & (F.lower("token") != F.col("token"))
    guarded = F.col("category").isin(*GUARDED)
    known = ~shout & ~guarded & (F.size("_m") > 0)
    category = F.when(shout, "protected").when(known & (F.size("_m") == 1), "learned_correction").when(known, "ambiguous_learned").otherwise(F.col("category"))
    auto = F.when(shout | guarded, F.col("token")).when(known & (F.size("_m") == 1), F.element_at("_m", 1)).when(known, F.col("token")).when(F.col("accepted"), F.col("suggestion")).otherwise(F.col("token"))
    words = F.coalesce(F.transform("candidates", lambda c: c["word"]), F.array().cast("array<string>"))
    foreign_word = F.when(F.col("foreign_word").isNotNull(), F.array("foreign_word")).otherwise(F.array().cast("array<string>"))
    rest = F.concat(F.col("_m"), foreign_word, words)
    every = F.when(F.array_contains(F.concat(F.array("token"), rest), F.col("auto")), F.concat(F.array("token"), rest)).otherwise(F.concat(F.array("token", "auto"), rest))
    rows = rows.withColumns({"_category": category, "auto": auto})
    return rows.select(
        key, "position", "token", F.col("_category").alias("category"), "auto", F.when(shout, F.array("token")).otherwise(F.slice(F.array_distinct(every), 1, SHOWN)).alias("suggestions"),
        (F.size("_m") > 0).alias("learned"), (F.col("auto") != F.col("token")).alias("changed"),
        F.when(shout, False).otherwise((F.col("_category") == "learned_correction") | (~known & ~guarded & F.coalesce("accepted", F.lit(False)))).alias("accepted"),
        F.col("_category").isin("ambiguous_learned", "ambiguous_exact", "foreign_exact", "ambiguous_near", "ambiguous_formal", "possible_foreign", "unresolved", "informal").alias("review_required"))


def automatic_sentences(df: DataFrame, key: str, text: str, analyzed: DataFrame) -> DataFrame:
    """``df`` plus ``auto``: the text with each word's automatic form, separators kept."""
    words = analyzed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "auto"))), lambda x: x["auto"]).alias("_w"))
    joined = df.join(words, key, "left")
    return joined.withColumn("auto", F.when(F.col("_w").isNull(), F.col(text)).otherwise(suggest.replace_words(T.blank(F.col(text)), F.col("_w")))).drop("_w")
