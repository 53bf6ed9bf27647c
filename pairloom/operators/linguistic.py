"""Evidence-based generation: learned phrase mappings and spelling templates put into sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import few
from . import generate, order

#: Preference of whole mappings over templates.
MAPPING_BONUS, TEMPLATE_BONUS = 1.5, 1.0


#: A template's trigger: what must stand in a token for it to apply.
TRIGGER = ["pos", "left", "old", "right", "place"]


def trigger_sites(words: DataFrame, longest: int, triggers: DataFrame | None = None) -> DataFrame:
    """(token, pos, left, old, right, place, site): the first site of every trigger in
    distinct ``words`` (token, pos); ``longest``: the largest length of ``old``.

    ``^`` and ``$`` stand for the token's ends, ``site`` counts characters from 1;
    ``place`` is prefix, suffix or internal.  ``triggers``: those that are wanted, so
    that no other site is grouped.
    """
    n = F.length("framed")
    framed = words.select("token", "pos", F.concat(F.lit("^"), F.col("token"), F.lit("$")).alias("framed"))
    sized = framed.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.lit(longest), n - 2))))
    at = sized.withColumn("site", F.explode(F.sequence(F.lit(1), n - F.col("k") - 1)))
    end = F.col("site") + F.col("k")
    place = F.when(F.col("site") == 1, "prefix").when(end == n - 1, "suffix").otherwise("internal")
    part = lambda start, size: F.substring(F.col("framed"), start, size)
    sites = at.select(
        "token", "pos", part(F.col("site"), F.lit(1)).alias("left"), part(F.col("site") + 1, F.col("k")).alias("old"), part(end + 1, F.lit(1)).alias("right"), place.alias("place"), "site")
    if triggers is not None:
        sites = sites.join(few(triggers.select(*TRIGGER).distinct()), TRIGGER, "left_semi")
    return sites.groupBy("token", *TRIGGER).agg(F.min("site").alias("site"))


def mapping_candidates(sentences: DataFrame, mappings: DataFrame, longest: int = 3) -> DataFrame:
    """(source_id, start, end, new, weight, kind): sentence windows that a mapping covers.

    ``sentences``: source_id, tokens.  Windows meet mappings by an equi join.
    """
    sized = sentences.select("source_id", "tokens", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("k")).filter(F.size("tokens") >= F.col("k"))
    windows = F.transform(F.sequence(F.lit(0), F.size("tokens") - F.col("k")), lambda i: F.struct(i.alias("start"), F.array_join(F.slice("tokens", i + 1, F.col("k")), " ").alias("w")))
    at = sized.select("source_id", "k", F.explode(windows).alias("x")).select("source_id", "k", "x.start", T.lookup_key(F.col("x.w"), None).alias("formal_key"))
    hit = at.join(mappings.select("formal_key", "informal_surface", "dominance", "count"), "formal_key")
    weight = MAPPING_BONUS * F.col("dominance") * F.log1p("count")
    return hit.select("source_id", "start", (F.col("start") + F.col("k")).alias("end"), F.col("informal_surface").alias("new"), weight.alias("weight"), F.lit("mapping").alias("kind"))


def changed_tokens(words: DataFrame, templates: DataFrame) -> DataFrame:
    """(token, pos, new, confidence, count): distinct ``words`` (token, pos) with the first site of
    a matching template changed.

    Words and templates meet on the whole trigger (tag, both neighbours, old text,
    place), so a word meets only templates that apply to it.
    """
    longest = templates.agg(F.max(F.length("old"))).first()[0]
    sites = trigger_sites(words.filter("token is not null").select("token", "pos").distinct(), longest or 0, templates)
    hit = sites.join(templates.select(*TRIGGER, F.col("new").alias("_new"), "confidence", "count"), TRIGGER)
    rest = F.substring(F.col("token"), F.col("site") + F.length("old"), F.length("token"))
    made = F.concat(F.substring(F.col("token"), F.lit(1), F.col("site") - 1), F.col("_new"), rest)
    return hit.select("token", "pos", made.alias("new"), "confidence", "count").filter("new <> token")


def template_candidates(tagged: DataFrame, templates: DataFrame) -> DataFrame:
    """As above, from tokens with a tag: (source_id, at, token, pos)."""
    made = tagged.join(changed_tokens(tagged, templates), ["token", "pos"])
    weight = TEMPLATE_BONUS * F.col("confidence") * F.log1p("count")
    return made.select("source_id", F.col("at").alias("start"), (F.col("at") + 1).alias("end"), "new", weight.alias("weight"), F.lit("template").alias("kind"))


def evidence_pairs(sentences: DataFrame, candidates: DataFrame, budgets: DataFrame, seed: int = 2026) -> DataFrame:
    """Sentences with up to their budget of non-overlapping edits.

    ``sentences``: source_id, source_row, formal, tokens.  Candidates are drawn
    without replacement by weighted keys, the same on every run.
    """
    u = order.unit_interval(seed, F.concat_ws(":", "source_id", "start", "end", "new"))
    keyed = candidates.withColumn("order", -order.weighted_key(F.greatest(u, F.lit(1e-12)), F.greatest("weight", F.lit(1e-9))))
    item = F.struct("order", "start", "end", F.concat_ws(":", "start", "new").alias("target"), "new", "kind")
    per = keyed.groupBy("source_id").agg(F.sort_array(F.collect_list(item)).alias("_c"))
    joined = sentences.join(per, "source_id", "left").join(budgets, "source_id", "left")
    none = F.expr("cast(array() as array<struct<order:double,start:int,end:int,target:string,new:string,kind:string>>)")
    joined = joined.withColumn("edits", F.coalesce(order.greedy_spans(F.col("_c"), F.coalesce("budget", F.lit(0))), none))
    starts = lambda i: F.filter("edits", lambda e: e["start"] == i)
    inside = lambda i: F.exists("edits", lambda e: (e["start"] < i) & (i < e["end"]))
    words = F.filter(F.transform("tokens", lambda w, i: F.when(inside(i), F.lit("")).otherwise(F.coalesce(F.try_element_at(F.transform(starts(i), lambda e: e["new"]), F.lit(1)), w))), lambda w: w != "")
    kinds = F.array_sort(F.array_distinct(F.transform("edits", lambda e: e["kind"])))
    return generate.pair_rows(joined, "evidence", F.array_join(words, " "), F.size("edits"), kinds, F.expr("cast(map() as map<string,int>)"), seed)
