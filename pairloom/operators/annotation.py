"""Annotation tables: latest views, token occurrences, lookups, learned mappings and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from . import audit, generate, order

#: Closed vocabularies of the annotation schema.
STATUSES = ("keep", "discard_false_positive", "discard_uninteresting", "skip_uncertain")
TOKEN = "array<struct<token:string,category:string,selected_candidate:string,final_correction:string,sentence_target:string>>"


def latest_kept(log: DataFrame, key: str, ordinal: str, formal: str, status: str = "status") -> DataFrame:
    """Latest row of each key, if it is kept and has a formal text, by key."""
    return order.keep_last(log, [key], [ordinal]).filter((F.col(status) == "keep") & (F.trim(T.blank(F.col(formal))) != "")).orderBy(key)


def occurrences(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """One row a token of a JSON payload: occurrence_id, position and the token pair."""
    each = rows.select(F.col(key).cast("string").alias("source_index"), F.posexplode(F.from_json(payload, TOKEN)).alias("token_position", "t"))
    target = F.coalesce(F.nullif(F.trim("t.sentence_target"), F.lit("")), F.nullif(F.trim("t.final_correction"), F.lit("")), F.nullif(F.trim("t.selected_candidate"), F.lit("")), F.col("t.token"))
    return each.select(
        F.concat_ws(":", "source_index", "token_position").alias("occurrence_id"), "source_index", "token_position",
        F.col("t.token").alias("informal_token"), target.alias("formal_token"), F.col("t.category").alias("category"))


def stale_rows(log: DataFrame, auto: str, manual: str, payload: str) -> DataFrame:
    """Rows whose sentence still equals the suggestion although the tokens say otherwise."""
    rebuilt = log.withColumn("reconstructed", T.reconstruct(F.col(payload)))
    return rebuilt.filter((T.collapse(F.col(auto)) == T.collapse(F.col(manual))) & (T.collapse(F.col("reconstructed")) != T.collapse(F.col(manual))))


def invalid_annotations(annotations: DataFrame, gold: DataFrame) -> DataFrame:
    """Annotations whose occurrence is gone, or whose token pair has drifted."""
    g = gold.select("occurrence_id", F.struct("informal_token", "formal_token").alias("_g"))
    joined = annotations.join(g, "occurrence_id", "left")
    drift = ~F.struct("informal_token", "formal_token").eqNullSafe(F.col("_g"))
    return joined.withColumn("issue", F.when(F.col("_g").isNull(), "orphan_occurrence_id").when(drift, "token_pair_changed")).filter("issue is not null").drop("_g")


def ambiguous_identity(annotations: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Automatic identity rows of keys that are ambiguous now."""
    auto = annotations.filter(F.col("notes").startswith("AUTO_IDENTITY_"))
    keyed = auto.withColumn("_k", T.lookup_key(F.col("formal_token"), None))
    return keyed.join(ambiguous.select(F.col("key").alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def set_columns_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Conditional update of several columns at once."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def seed_lookup(dictionary: DataFrame, ordinal: str, word: str, lists: list[str]) -> DataFrame:
    """One row a key: the first surface, and ordered distinct values of each list column."""
    keyed = dictionary.withColumn("key", T.lookup_key(F.col(word), None))

    def in_order(c: str) -> Column:
        items = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(c).alias("v"))))
        return F.array_distinct(F.transform(items, lambda x: x["v"])).alias(f"{c}_values")

    ordered = [in_order(c) for c in lists]
    return keyed.filter("key <> ''").groupBy("key").agg(F.min_by(word, ordinal).alias("surface"), F.count(F.lit(1)).alias("entry_count"), *ordered)


def merge_lookups(curated: DataFrame, seed: DataFrame, fields: list[str], ambiguous_wins: bool = False) -> DataFrame:
    """Curated rows override seed rows; with ``ambiguous_wins`` an ambiguous seed row overrides both."""
    c = curated.select("key", F.struct(*fields).alias("_c"))
    s = seed.select("key", F.struct(*fields).alias("_s"), *(["ambiguous"] if ambiguous_wins else []))
    joined = c.join(s, "key", "full_outer")
    keep = F.when(F.coalesce(F.col("ambiguous"), F.lit(False)), F.col("_s")).otherwise(F.coalesce("_c", "_s")) if ambiguous_wins else F.coalesce("_c", "_s")
    return joined.select("key", keep.alias("_v"), F.when(F.col("_c").isNull(), "seed").otherwise("curated").alias("origin")).select("key", "_v.*", "origin")


def homographs(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(key, language): only in one list, or in both."""
    x, y = a.select("key").distinct().withColumn("_a", F.lit(True)), b.select("key").distinct().withColumn("_b", F.lit(True))
    language = F.when(F.col("_b").isNull(), names[0]).when(F.col("_a").isNull(), names[1]).otherwise("both")
    return x.join(y, "key", "full_outer").select("key", language.alias("language"))


def learned_corrections(log: DataFrame, ordinal: str, informal: str, formal: str) -> DataFrame:
    """Distinct corrections of each token, newest first."""
    keyed = log.select(T.lookup_key(F.col(informal), None).alias("key"), F.col(formal).alias("formal"), F.col(ordinal).alias("_o")).filter("key <> '' and formal <> ''")
    newest = keyed.groupBy("key", "formal").agg(F.max("_o").alias("_o"))
    items = F.sort_array(F.collect_list(F.struct("_o", "formal")), asc=False)
    return newest.groupBy("key").agg(F.transform(items, lambda x: x["formal"]).alias("equivalents"))


def confirmed_default(reviews: DataFrame, key: str, fields: list[str], ordinal: str, least: int = 2) -> DataFrame:
    """The agreed values of a key: at least ``least`` equal reviews and no tie for the most."""
    counted = reviews.groupBy(key, F.struct(*fields).alias("_sig")).agg(F.count(F.lit(1)).alias("_n"), F.max(ordinal).alias("_last"))
    ranked = order.top_per_group(counted, [key], [F.desc("_n"), F.desc("_last")], 2)
    top = ranked.groupBy(key).agg(
        F.max_by("_sig", F.struct(F.col("_n"), F.col("_last"))).alias("_sig"), F.max("_n").alias("reviews"), F.count_if(F.lit(True)).alias("_k"), F.min("_n").alias("_second"))
    clear = (F.col("reviews") >= least) & ((F.col("_k") == 1) | (F.col("_second") < F.col("reviews")))
    return top.filter(clear).select(key, "_sig.*", "reviews")


def eligible_evidence(annotations: DataFrame) -> DataFrame:
    """Reviewed, unprotected occurrences whose both sides are in the language."""
    return annotations.filter(
        (F.col("review_status") == "reviewed") & (F.col("target_language") == "wo") & (F.col("source_language") == "wo") & (F.col("protected") == "no")
        & (F.trim(T.blank(F.col("formal_token"))) != "") & (F.trim(T.blank(F.col("informal_token"))) != ""))


def error_profile(evidence: DataFrame) -> DataFrame:
    """(pos, total, changed, change_rate, errors): error counts of each part of speech."""
    changed = T.lookup_key(F.col("formal_token"), None) != T.lookup_key(F.col("informal_token"), None)
    base = evidence.withColumn("_c", changed).groupBy("pos").agg(F.count(F.lit(1)).alias("total"), F.count_if("_c").alias("changed"))
    errors = evidence.select("pos", F.explode("error_types").alias("e")).groupBy("pos", "e").count().groupBy("pos").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("e", "count")))).alias("errors"))
    return base.join(errors, "pos", "left").withColumn("change_rate", F.col("changed") / F.col("total"))


def with_error_types(evidence: DataFrame) -> DataFrame:
    """``evidence`` plus ``error_types``, found once for each distinct pair of its two sides."""
    from ..functions import errors as E
    from ..sources.shared import few

    sides = ["formal_token", "informal_token"]
    pairs = generate.spread(evidence.select(*sides).distinct()).withColumn("error_types", E.error_types_once(F.col("informal_token"), F.col("formal_token")))
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in sides]
    return evidence.alias("_l").join(few(pairs, 20_000).alias("_r"), same).select("_l.*", "_r.error_types")


def learn_mappings(evidence: DataFrame, ordinal: str, min_count: int = 1, min_dominance: float = 0.0) -> DataFrame:
    """Formal -> informal mappings with counts, dominance among the formal's uses, and sets of tags."""
    keyed = evidence.withColumns({"formal_key": T.lookup_key(F.col("formal_token"), None), "informal_key": T.lookup_key(F.col("informal_token"), None)})
    totals = keyed.groupBy("formal_key").agg(F.count(F.lit(1)).alias("formal_total"))
    counted = keyed.filter("formal_key <> informal_key").groupBy("formal_key", "informal_key").agg(
        F.count(F.lit(1)).alias("count"), F.min_by("formal_token", ordinal).alias("formal_surface"), F.min_by("informal_token", ordinal).alias("informal_surface"),
        F.array_sort(F.collect_set("pos")).alias("pos_set"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("error_types")))).alias("error_set"))
    out = counted.join(totals, "formal_key").withColumn("dominance", F.col("count") / F.col("formal_total"))
    return out.filter((F.col("count") >= min_count) & (F.col("dominance") >= min_dominance))


def learn_templates(evidence: DataFrame, min_count: int = 1, min_dominance: float = 0.0, allowed: list[str] | None = None) -> DataFrame:
    """Character edits by tag, error type, operation, both texts, both neighbours and
    place in the word; confidence is the count over the uses of the same trigger.

    The error type is the pair's first allowed one; pairs without one, phrases
    and unchanged pairs teach nothing.
    """
    from ..functions.errors import ERROR_TYPES, primary_error

    formal, informal = T.lookup_key(F.col("formal_token"), None), T.lookup_key(F.col("informal_token"), None)
    kind = primary_error(F.col("error_types"), list(allowed or [t for t in ERROR_TYPES if t not in ("identity", "uncertain")]), "")
    rows = evidence.select("pos", formal.alias("f"), informal.alias("i"), kind.alias("error_type")).filter("f <> i and error_type <> '' and not contains(f, ' ')")
    # equal evidence has equal edits
    rows = generate.spread(rows.groupBy("pos", "f", "i", "error_type").agg(F.count(F.lit(1)).alias("n")))
    steps = rows.select("pos", "error_type", "f", "n", F.explode(S.edits(F.col("f"), F.col("i"))).alias("e"))
    start, end, size = F.col("e.a_start"), F.col("e.a_end"), F.length("f")
    left = F.when(start > 0, F.substring(F.col("f"), start, F.lit(1))).otherwise(F.lit("^"))
    right = F.when(end < size, F.substring(F.col("f"), end + 1, F.lit(1))).otherwise(F.lit("$"))
    place = F.when(start == 0, "prefix").when(end == size, "suffix").otherwise("internal")
    sig = steps.select("pos", "error_type", F.col("e.op").alias("operation"), F.col("e.old").alias("old"), F.col("e.new").alias("new"), left.alias("left"), right.alias("right"), place.alias("place"), "n")
    columns = [c for c in sig.columns if c != "n"]
    counted = sig.groupBy(*columns).agg(F.sum("n").alias("count"))
    trigger = [c for c in columns if c != "new"]
    totals = counted.groupBy(*trigger).agg(F.sum("count").alias("trigger_total"))
    out = counted.join(totals, trigger).withColumn("confidence", F.col("count") / F.col("trigger_total"))
    return out.filter((F.col("count") >= min_count) & (F.col("confidence") >= min_dominance))


def edit_budgets(sentences: DataFrame, evidence: DataFrame, key: str, cap: int = 3) -> DataFrame:
    """Changed tokens of each sentence, zeros included, capped."""
    changed = evidence.filter(T.lookup_key(F.col("formal_token"), None) != T.lookup_key(F.col("informal_token"), None)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return sentences.select(key).join(changed, key, "left").select(key, F.least(F.lit(cap), F.coalesce("_n", F.lit(0))).cast("int").alias("budget"))


def token_protected(token: Column, position: Column, flagged: Column) -> Column:
    """All capitals, a capital after the first word, or flagged by a lookup."""
    return flagged | (token.rlike("^[\\p{Lu}\\p{Nd}]{2,}$")) | ((position > 0) & token.rlike("^\\p{Lu}\\p{Ll}"))


def coverage(rows: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Progress counters in one aggregate."""
    done = annotations.select(key, "status").distinct()
    return rows.select(key).distinct().join(done, key, "left").agg(
        F.count_distinct(key).alias("total"), F.count_distinct(F.when(F.col("status").isNotNull(), F.col(key))).alias("annotated"),
        *[F.count_distinct(F.when(F.col("status") == s, F.col(key))).alias(s) for s in STATUSES])


def apply_if_unchanged(log: DataFrame, changes: DataFrame, key: str, ordinal: str, column: str) -> DataFrame:
    """Rows to append: latest rows with a new value, where the value is still the expected one.

    ``changes``: key, expected, value.  Raises if any row has moved on.
    """
    latest = order.keep_last(log, [key], [ordinal])
    joined = latest.join(audit.require_unique(changes, [key], "changes"), key)
    moved = joined.filter(~F.col(column).eqNullSafe(F.col("expected"))).limit(3).collect()
    if moved:
        raise ValueError(f"changed since review: {[r[key] for r in moved]}")
    return joined.withColumn(column, F.col("value")).withColumn(ordinal, F.col(ordinal) + 1).select(*log.columns)


def map_pos(labels: Column, table: dict[str, str]) -> Column:
    """Distinct tags whose keyword occurs in a free-text label, in the table's order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(F.lower(T.blank(labels)), F.lit(k)), F.lit(v)) for k, v in table.items()])))


def canonical_order(values: Column, enum: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(e) for e in enum]), lambda e: F.array_contains(values, e))
