"""Generators of (informal, formal) pairs with edit provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import similarity as S
from ..functions import text as T
from . import audit, factors, order

SEED = 2026


def formal_sources(df: DataFrame, column: str, row: str, corpus: str = "parallel") -> DataFrame:
    """(source_id, source_row, formal): stripped, non-empty; the id is the stored row number."""
    out = df.select(F.concat_ws(":", F.lit(corpus), F.col(row).cast("string")).alias("source_id"), F.col(row).alias("source_row"), F.trim(T.blank(F.col(column))).alias("formal"))
    return out.filter("formal <> ''")


def pair_rows(df: DataFrame, method: str, informal: Column, edit_count: Column, error_types: Column, applied: Column, seed: int = SEED) -> DataFrame:
    """The pair schema that all generators share."""
    return df.select(
        "source_id", "source_row", F.lit(method).alias("method"), F.lit(seed).alias("seed"), informal.alias("informal"), "formal",
        (~informal.eqNullSafe(F.col("formal"))).alias("changed"), edit_count.cast("int").alias("edit_count"),
        error_types.alias("error_types"), applied.alias("applied_rules"))


def identity_pairs(sources: DataFrame) -> DataFrame:
    none = F.lit(None).cast("map<string,int>")
    return pair_rows(sources, "identity", F.col("formal"), F.lit(0), F.array().cast("array<string>"), F.coalesce(none, F.expr("cast(map() as map<string,int>)")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in a given number of tasks, as rows of few bytes would be gathered in a few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rule_pairs(sources: DataFrame, spans: Column | None = None) -> DataFrame:
    """Spelling rules with per-rule counts; protected stretches stay.

    Without spans a text's result depends on the text alone, so each distinct one
    is spelled once, in as many tasks as a shuffle has.
    """
    from ..sources.shared import few

    if spans is None:
        texts = spread(sources.select("formal").distinct())
        made = sources.join(few(texts.withColumn("_m", R.informalize(F.col("formal"), None)), 20_000), "formal")
    else:
        made = sources.withColumn("_m", R.informalize(F.col("formal"), spans))
    counts = F.col("_m.counts")
    total = F.aggregate(F.map_values(counts), F.lit(0), lambda a, x: a + x)
    return pair_rows(made, "rules", F.col("_m.text"), total, F.array_sort(F.map_keys(counts)), counts)


def alignment_candidates(sources: DataFrame, lexicon: DataFrame, source: Column, target: Column, min_p: float = 0.0) -> DataFrame:
    """(source_id, score, start, end, target): tokens of the formal side with a
    translation that occurs in the paired sentence.  All joins are equi joins on
    the row and the word."""
    words = sources.select("source_id", F.posexplode(source).alias("start", "src"))
    other = sources.select("source_id", F.explode(F.array_distinct(target)).alias("tgt"))
    found = words.join(lexicon.filter(F.col("p") >= min_p), "src").join(other, ["source_id", "tgt"])
    return found.select("source_id", F.col("p").alias("score"), "start", (F.col("start") + 1).alias("end"), F.col("tgt").alias("target"))


def substitute_greedily(sources: DataFrame, candidates: DataFrame, tokens: Column, ratio: float = 0.2) -> DataFrame:
    """``sources`` plus ``new_tokens`` and ``substitutions``.

    Budget: half-even rounding of ``ratio`` times the tokens, at least one.
    Candidates of a row are sorted and folded inside the row.
    """
    item = F.struct((-F.col("score")).alias("order"), "start", "target", "end", "score")
    per = candidates.groupBy("source_id").agg(F.sort_array(F.collect_list(item)).alias("_c"))
    joined = sources.withColumn("_tokens", tokens).join(per, "source_id", "left")
    budget = F.greatest(F.lit(1), F.bround(F.size("_tokens") * F.lit(ratio)).cast("int"))
    chosen = F.coalesce(order.greedy_spans(F.col("_c"), budget), F.expr("array()").cast("array<struct<order:double,start:int,target:string,end:int,score:double>>"))
    joined = joined.withColumn("substitutions", chosen)
    swap = lambda w, i: F.coalesce(F.try_element_at(F.transform(F.filter("substitutions", lambda s: s["start"] == i), lambda s: s["target"]), F.lit(1)), w)
    return joined.withColumn("new_tokens", F.transform("_tokens", swap)).drop("_tokens", "_c")


def aligned_pairs(sources: DataFrame, lexicon: DataFrame, source: Column, target: Column, ratio: float = 0.2, min_p: float = 0.0) -> DataFrame:
    """Code-switched pairs: aligned words are inserted, the rest is spelled by the rules."""
    found = alignment_candidates(sources, lexicon, source, target, min_p)
    switched = substitute_greedily(sources, found, source, ratio)
    spelled = F.transform(F.col("new_tokens"), lambda w: w)
    made = switched.withColumn("_plain", F.array_join(spelled, " "))
    spans = F.col("substitutions")
    starts = F.transform(F.sequence(F.lit(0), F.size("new_tokens") - 1), lambda i: F.when(i == 0, F.lit(0)).otherwise(F.length(F.array_join(F.slice("new_tokens", F.lit(1), i), " ")) + 1))
    made = made.withColumn("_at", starts)
    kept = F.transform(spans, lambda s: F.struct(F.get("_at", s["start"]).cast("int").alias("start"), (F.get("_at", s["start"]) + F.length(s["target"])).cast("int").alias("end")))
    made = made.withColumn("_m", R.informalize(F.col("_plain"), kept))
    total = F.aggregate(F.map_values("_m.counts"), F.lit(0), lambda a, x: a + x)
    kinds = F.array_compact(F.array(F.when(F.size(spans) > 0, "alignment_code_switch"), F.when(total > 0, "orthographic_rules")))
    return pair_rows(made, "aligned", F.col("_m.text"), F.size(spans) + total, kinds, F.col("_m.counts"))


#: Prices of longer n-grams.
SIZE_PENALTY = {1: 1.0, 2: 0.85, 3: 0.70}


def train_vectors(pairs: DataFrame, source: Column, target: Column, largest: int = 3, size: int = 150, window: int = 10, min_count: int = 2, epochs: int = 4, seed: int = SEED) -> DataFrame:
    """(gram, vector) of the n-grams of both sides of every pair, trained together.

    Vectors are ``size`` directions of the grams' positive pointwise mutual
    information within ``window``; ``epochs`` are rounds of the factorisation.
    """
    counts = factors.near_counts(pairs, F.concat(T.ngrams(source, largest), T.ngrams(target, largest)), window, min_count)
    return factors.factor_vectors(factors.positive_information(counts), size, epochs, seed)


def save_resources(vectors: DataFrame, lexicon: DataFrame, folder: str, config: dict | None = None) -> dict:
    """Vectors and lexicon with one manifest; refuses to overwrite."""
    from ..sources import writers

    return writers.write_bundle({"vectors": vectors, "lexicon": lexicon}, folder, config)


def load_resources(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, lexicon) as ``save_resources`` wrote them."""
    return spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/lexicon")


def embedding_candidates(pairs: DataFrame, vectors: DataFrame, lexicon: DataFrame, source: Column, target: Column, largest: int = 2,
                         min_similarity: float = 0.70, min_alignment: float = 0.01, sigma: float = 0.35) -> DataFrame:
    """(source_id, score, start, end, target): n-grams of the two sides of a row with
    near vectors and aligned words.

    score = similarity * (1 + alignment) * position * size penalty; the position
    compares the middles of the n-grams, relative to the sides' lengths.
    """
    penalty = F.create_map(*[F.lit(x) for p in SIZE_PENALTY.items() for x in p])

    def grams(side: Column) -> DataFrame:
        base = pairs.select("source_id", side.alias("w"), F.explode(F.sequence(F.lit(1), F.lit(largest))).alias("size")).filter(F.size("w") >= F.col("size"))
        return base.select("source_id", "size", F.size("w").alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("size")), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i + 1, F.col("size")), "_").alias("gram")))).alias("g")).select("source_id", "size", "n", "g.at", "g.gram")

    v = vectors.select("gram", "vector")
    middle = (F.col("at") + F.col("size") / 2) / F.col("n")
    a = grams(source).join(v, "gram").select("source_id", "size", F.col("at").alias("i"), middle.alias("s"), F.col("gram").alias("a"), F.col("vector").alias("x"))
    b = grams(target).join(v, "gram").select("source_id", "size", F.col("at").alias("j"), middle.alias("t"), F.col("gram").alias("b"), F.col("vector").alias("y"))
    both = a.join(b, ["source_id", "size"]).filter("a <> b").withColumn("similarity", S.cosine(F.col("x"), F.col("y"))).filter(F.col("similarity") >= min_similarity).drop("x", "y")
    parts = both.select("source_id", "size", "i", "j", F.posexplode(F.split("a", "_")).alias("at", "src"), "b").select("source_id", "size", "i", "j", "at", "src", F.explode(F.split("b", "_")).alias("tgt"))
    aligned = parts.join(lexicon.select("src", "tgt", "p"), ["src", "tgt"], "left").groupBy("source_id", "size", "i", "j", "at").agg(F.max(F.coalesce("p", F.lit(0.0))).alias("p"))
    aligned = aligned.groupBy("source_id", "size", "i", "j").agg(F.avg("p").alias("alignment")).filter(F.col("alignment") >= min_alignment)
    scored = both.join(aligned, ["source_id", "size", "i", "j"])
    gap = F.col("s") - F.col("t")
    score = F.col("similarity") * (1 + F.col("alignment")) * F.exp(-(gap * gap) / (2 * sigma * sigma)) * F.element_at(penalty, F.col("size"))
    return scored.select("source_id", score.alias("score"), F.col("i").alias("start"), (F.col("i") + F.col("size")).alias("end"), F.replace("b", F.lit("_"), F.lit(" ")).alias("target"))


def embedding_pairs(sources: DataFrame, candidates: DataFrame, tokens: Column, most: int = 2) -> DataFrame:
    """Code-switched pairs: up to ``most`` n-grams change language, the rest is spelled by the rules.

    Best score first, then the longer n-gram, the earlier place and the smaller
    target; chosen ones neither overlap nor repeat a target.
    """
    item = F.struct((-F.col("score")).alias("order"), (F.col("start") - F.col("end")).alias("longer"), "start", "target", "end", "score")
    per = candidates.groupBy("source_id").agg(F.sort_array(F.collect_list(item)).alias("_c"))
    kind = "array<struct<order:double,longer:int,start:int,target:string,end:int,score:double>>"
    made = sources.withColumn("_w", tokens).join(per.withColumn("_c", F.col("_c").cast(kind)), "source_id", "left")
    made = made.withColumn("_e", F.coalesce(order.greedy_spans(F.col("_c"), most), F.expr(f"cast(array() as {kind})")))
    # one piece a place: the target where a span starts, nothing inside it, else the word
    begins = lambda i: F.filter("_e", lambda e: e["start"] == i)
    inside = lambda i: F.exists("_e", lambda e: (e["start"] < i) & (i < e["end"]))
    piece = lambda w, i: F.struct(F.when(inside(i), "").otherwise(F.coalesce(F.try_element_at(F.transform(begins(i), lambda e: e["target"]), F.lit(1)), w)).alias("text"), (F.size(begins(i)) > 0).alias("new"))
    made = made.withColumn("_p", F.filter(F.transform("_w", piece), lambda p: p["text"] != ""))
    at = lambda i: F.when(i == 0, 0).otherwise(F.length(F.array_join(F.transform(F.slice("_p", F.lit(1), i), lambda p: p["text"]), " ")) + 1)
    spans = F.filter(F.transform("_p", lambda p, i: F.struct(at(i).cast("int").alias("start"), (at(i) + F.length(p["text"])).cast("int").alias("end"), p["new"].alias("new"))), lambda s: s["new"])
    kept = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    made = made.withColumn("_m", R.informalize(F.array_join(F.transform("_p", lambda p: p["text"]), " "), kept))
    total = F.aggregate(F.map_values("_m.counts"), F.lit(0), lambda a, x: a + x)
    kinds = F.array_compact(F.array(F.when(F.size("_e") > 0, "embedding_code_switch"), F.when(total > 0, "orthographic_rules")))
    return pair_rows(made, "embedding", F.col("_m.text"), F.size("_e") + total, kinds, F.col("_m.counts"))


def external_audit(raw: DataFrame, row: str, formal: str, informal: str, form: str | None = "NFKC") -> DataFrame:
    """External pairs with all rejection reasons; the first of equal pairs stays."""
    f, i = T.collapse(F.col(formal)), T.unwrap(F.col(informal))
    out = raw.select(
        F.concat_ws(":", F.lit("external"), F.col(row).cast("string")).alias("source_id"), F.col(row).alias("source_row"), i.alias("informal"), f.alias("formal"),
        T.wrapper_status(F.col(informal)).alias("wrapper_status"), T.compatibility_key(f, form).alias("formal_key"), T.compatibility_key(i, form).alias("informal_key"))
    first = out.groupBy("formal_key", "informal_key").agg(F.min("source_row").alias("_first"))
    out = out.join(first, ["formal_key", "informal_key"])
    reasons = audit.reject_reasons(
        ("empty_formal", F.col("formal") == ""), ("empty_informal", F.col("informal") == ""),
        ("malformed_wrapper", (F.col("wrapper_status") == "malformed") | F.col("informal").rlike("<[^>]+>")),
        ("unchanged_normalized", (F.col("formal_key") != "") & (F.col("formal_key") == F.col("informal_key"))),
        ("duplicate_pair", F.col("source_row") != F.col("_first")))
    return out.withColumns({
        "rejection_reasons": reasons, "changed": F.col("formal_key") != F.col("informal_key"), "edit_count": F.levenshtein("informal", "formal"),
    }).withColumn("accepted", F.size("rejection_reasons") == 0).drop("_first")


def reason_counts(audited: DataFrame) -> DataFrame:
    return audited.select(F.explode("rejection_reasons").alias("reason")).groupBy("reason").count()


def variant_pairs(sources: DataFrame, mappings: DataFrame, max_edits: int = 2, seed: int = SEED) -> DataFrame:
    """Replace formal words by mined variants: (formal_token, informal_token, score).

    The choice among a word's variants and the order of edits come from keyed
    draws, so reruns and partitionings agree.
    """
    words = sources.select("source_id", F.posexplode(F.split("formal", " ")).alias("at", "word"))
    keyed = words.withColumn("formal_token", T.token_edges(F.col("word")))
    hits = keyed.join(mappings, "formal_token").withColumn("_u", order.unit_interval(seed, F.concat_ws(":", "source_id", "at", "informal_token")))
    choice = F.max_by(F.struct("formal_token", "informal_token"), order.weighted_key(F.greatest("_u", F.lit(1e-12)), F.col("score")))
    one = hits.groupBy("source_id", "at").agg(choice.alias("_c"), F.max("score").alias("score"))
    ranked = order.top_per_group(one.withColumn("_h", order.hash_rank(seed, F.concat_ws(":", "source_id", "at"))), ["source_id"], [F.col("_h")], max_edits)
    edits = ranked.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("at", F.col("_c")))).alias("_e"))
    joined = sources.join(edits, "source_id", "left").withColumn("_e", F.coalesce("_e", F.expr("cast(map() as map<int,struct<formal_token:string,informal_token:string>>)")))
    swap = lambda w, i: F.when(F.map_contains_key("_e", i), F.regexp_replace(w, F.lit("(?iU)[\\p{L}\\p{M}]+(?:[-\\u2019'][\\p{L}\\p{M}]+)*"), F.try_element_at("_e", i)["informal_token"])).otherwise(w)
    informal = F.array_join(F.transform(F.split("formal", " "), swap), " ")
    return pair_rows(joined, "variants", informal, F.size(F.map_keys("_e")), F.when(F.size(F.map_keys("_e")) > 0, F.array(F.lit("mined_variant"))).otherwise(F.array().cast("array<string>")), F.expr("cast(map() as map<string,int>)"))


def best_candidates(candidates: DataFrame) -> DataFrame:
    """The best target of each place of a row; ties: the smaller target."""
    item = F.struct("score", "end", "target")
    best = F.min_by(item, F.struct((-F.col("score")).alias("s"), F.col("target").alias("t")))
    return candidates.groupBy("source_id", "start").agg(best.alias("_b")).select("source_id", "start", "_b.score", "_b.end", "_b.target")


def readable_alignment(aligned: DataFrame, key: str) -> DataFrame:
    """(key, alignment): ``target<-source`` in target order, ``-`` where unaligned."""
    shown = F.concat_ws("<-", "tgt", F.coalesce(F.nullif("src", F.lit("")), F.lit("-")))
    return aligned.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", shown.alias("x")))), lambda s: s["x"]), " ").alias("alignment"))
