"""Corpus scores of predictions: character and word error, chrF, corrections, intervals.

Row-wise counts come first (built-ins for characters, Arrow functions for token
distances, n-gram overlaps and edit sets), then one aggregate; nothing else is
shuffled.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from . import audit

ORDERS = 6


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _overlap(p: str, r: str) -> list[dict[str, int]]:
    """Clipped n-gram counts by order, white space left out."""
    p, r = "".join(p.split()), "".join(r.split())
    out = []
    for k in range(1, ORDERS + 1):
        made, want = max(0, len(p) - k + 1), max(0, len(r) - k + 1)
        if p == r:
            shared = made
        else:
            left = Counter(r[i : i + k] for i in range(want))
            shared = sum(min(n, left[g]) for g, n in Counter(p[i : i + k] for i in range(made)).items() if g in left)
        out.append({"matched": shared, "predicted": made, "expected": want})
    return out


def _edit_set(a: list[str], b: list[str]) -> set[tuple[int, int, str]]:
    return set() if a == b else {(i, j, " ".join(b[k:m])) for _, i, j, k, m in S.opcodes(a, b)}


COUNTS = "struct<word_edits:bigint,ngrams:array<struct<matched:bigint,predicted:bigint,expected:bigint>>,tp:bigint,fp:bigint,fn:bigint>"


def compared(prediction: Column, reference: Column, source: Column, p_words: Column, r_words: Column, s_words: Column) -> Column:
    """All counts that need Python, in one Arrow pass; without a source there are no corrections."""
    whole = pa.int64()
    kind = pa.struct([("word_edits", whole), ("ngrams", pa.list_(pa.struct([("matched", whole), ("predicted", whole), ("expected", whole)]))), ("tp", whole), ("fp", whole), ("fn", whole)])

    @F.arrow_udf(COUNTS)
    def run(p: pa.Array, r: pa.Array, s: pa.Array, pw: pa.Array, rw: pa.Array, sw: pa.Array) -> pa.Array:
        rows = []
        for pt, rt, st, a, b, c in zip(*(x.to_pylist() for x in (p, r, s, pw, rw, sw)), strict=True):
            gold, made = (_edit_set(c, b), _edit_set(c, a)) if st is not None else (set(), set())
            hit = len(gold & made)
            rows.append({"word_edits": 0 if a == b else int(S.edit_distance(a, b)), "ngrams": _overlap(pt, rt), "tp": hit, "fp": len(made) - hit, "fn": len(gold) - hit})
        return pa.array(rows, kind)

    return run(prediction, reference, source, p_words, r_words, s_words)


def row_counts(df: DataFrame, source: str | None, prediction: str, reference: str, form: str | None = "NFC") -> DataFrame:
    """``df`` plus everything that corpus scores sum up."""
    texts = {"_p": prediction, "_r": reference} | ({} if source is None else {"_s": source})
    out = df.withColumns({k: T.evaluation_text(F.col(c), form) for k, c in texts.items()})
    out = out if source is not None else out.withColumn("_s", F.lit(None).cast("string"))
    out = out.withColumns({f"{k}w": T.tokens(F.col(k), "evaluation") for k in ("_p", "_r", "_s")})
    out = out.withColumn("_c", compared(*[F.col(c) for c in ("_p", "_r", "_s", "_pw", "_rw", "_sw")]))
    out = out.withColumns({
        "char_edits": F.levenshtein("_p", "_r").cast("long"), "reference_chars": F.length("_r").cast("long"),
        "word_edits": F.col("_c.word_edits"), "reference_words": F.size("_rw").cast("long"),
        "exact": (F.col("_p") == F.col("_r")).cast("long"), "ngrams": F.col("_c.ngrams"),
    })
    if source is not None:
        same = (F.col("_s") == F.col("_r")).cast("long")
        out = out.withColumns({
            "tp": F.col("_c.tp"), "fp": F.col("_c.fp"), "fn": F.col("_c.fn"),
            "unchanged": same, "overcorrected": same * (F.col("_p") != F.col("_r")).cast("long"),
        })
    return out.drop("_p", "_r", "_s", "_pw", "_rw", "_sw", "_c")


def char_counts(df: DataFrame, prediction: str, reference: str, form: str | None = "NFC") -> DataFrame:
    """``df`` plus ``char_edits`` and ``reference_chars`` only."""
    p, r = T.evaluation_text(F.col(prediction), form), T.evaluation_text(F.col(reference), form)
    return df.withColumns({"char_edits": F.levenshtein(p, r).cast("long"), "reference_chars": F.length(r).cast("long")})


def scores(df: DataFrame, prediction: str, reference: str, source: str | None = None, by: list[str] | None = None, form: str | None = "NFC") -> DataFrame:
    """One row a group: rows, cer, wer, chrf, exact_match and, with a source, correction scores."""
    counted = row_counts(df, source, prediction, reference, form)
    sums = [F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"_{c}") for c in ("char_edits", "reference_chars", "word_edits", "reference_words", "exact")]]
    for k in range(ORDERS):
        sums += [F.sum(F.col("ngrams")[k][c]).alias(f"_{c}{k}") for c in ("matched", "predicted", "expected")]
    if source is not None:
        sums += [F.sum(c).alias(f"_{c}") for c in ("tp", "fp", "fn", "unchanged", "overcorrected")]
    out = counted.groupBy(*(by or [])).agg(*sums)
    used = [(F.col(f"_predicted{k}") + F.col(f"_expected{k}") > 0) for k in range(ORDERS)]
    orders = sum((u.cast("int") for u in used[1:]), used[0].cast("int"))
    mean = lambda part: _ratio(sum((F.when(u, _ratio(F.col(f"_matched{k}"), F.col(f"_{part}{k}"))).otherwise(0.0) for k, u in enumerate(used)), F.lit(0.0)), orders)
    out = out.withColumns({"_precision": mean("predicted"), "_recall": mean("expected")})
    chrf = 100.0 * _ratio(5.0 * F.col("_precision") * F.col("_recall"), 4.0 * F.col("_precision") + F.col("_recall"))
    named = [
        *(by or []), "rows", _ratio(F.col("_char_edits"), F.col("_reference_chars")).alias("cer"),
        _ratio(F.col("_word_edits"), F.col("_reference_words")).alias("wer"), chrf.alias("chrf"), _ratio(F.col("_exact"), F.col("rows")).alias("exact_match"),
    ]
    if source is not None:
        p, r = _ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")), _ratio(F.col("_tp"), F.col("_tp") + F.col("_fn"))
        named += [
            F.col("_tp").alias("correction_tp"), F.col("_fp").alias("correction_fp"), F.col("_fn").alias("correction_fn"),
            p.alias("correction_precision"), r.alias("correction_recall"), _ratio(2 * p * r, p + r).alias("correction_f1"),
            _ratio(F.col("_fp"), F.col("_tp") + F.col("_fp")).alias("overcorrection_rate"), F.col("_unchanged").alias("unchanged_reference_rows"),
            _ratio(F.col("_overcorrected"), F.col("_unchanged")).alias("unchanged_sentence_overcorrection_rate"),
        ]
    return out.select(*named)


def identity_scores(df: DataFrame, source: str, reference: str) -> DataFrame:
    return scores(df, source, reference, source)


#: Rows of one bucket of the bootstrap at first, and most buckets; beyond them the buckets grow.
BUCKET_ROWS, MAX_BUCKETS = 10_000, 256


def bootstrap_cer(df: DataFrame, prediction: str, reference: str, baseline: str | None = None, key: str = "source_id",
                  resamples: int = 5000, seed: int = 2026, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Percentile interval of the error rate (and of its change against a baseline column).

    Rows are dealt by key to buckets.  How many of a resample's draws fall into
    each bucket is one multinomial draw; inside a bucket they are uniform.  So
    resamples are those of the whole table, and only their sums are collected.
    """
    from ..sources.shared import cut

    base = df.withColumn("_e", F.lit(0).cast("long"))
    if baseline is not None:
        base = char_counts(df, baseline, reference).withColumnRenamed("char_edits", "_e").drop("reference_chars")
    counted = char_counts(base, prediction, reference)
    counted = cut(counted.select(F.xxhash64(key).alias("_h"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("char_edits", "reference_chars", "_e")]))
    n, edits, chars, base = counted.agg(F.count(F.lit(1)), F.sum("char_edits"), F.sum("reference_chars"), F.sum("_e")).first()
    buckets = max(1, min(MAX_BUCKETS, -(-n // bucket_rows)))
    dealt = counted.withColumn("_bucket", F.pmod("_h", F.lit(buckets)).cast("int"))
    sizes = np.zeros(buckets, np.int64)
    for r in dealt.groupBy("_bucket").count().collect():
        sizes[r[0]] = r[1]
    takes = np.random.default_rng(seed).multinomial(n, sizes / max(n, 1), resamples)

    def draw(table: pa.Table) -> pa.Table:
        at = table["_bucket"][0].as_py()
        rng = np.random.default_rng([seed, at])
        values = np.stack([table[c].to_numpy() for c in ("_h", "char_edits", "reference_chars", "_e")], 1)
        values = values[np.lexsort(values.T[::-1])][:, 1:]
        sums = np.array([values[rng.integers(0, len(values), k)].sum(0) for k in takes[:, at]])
        return pa.table({"_resample": np.arange(resamples), "e": sums[:, 0], "c": sums[:, 1], "b": sums[:, 2]})

    drawn = dealt.groupBy("_bucket").applyInArrow(draw, "_resample long, e long, c long, b long")
    sums = np.array(drawn.groupBy("_resample").agg(F.sum("e"), F.sum("c"), F.sum("b")).orderBy("_resample").collect())
    rate = sums[:, 1] / sums[:, 2]
    out = [("cer", float(edits / chars), *map(float, np.percentile(rate, [2.5, 97.5])))]
    if baseline is not None:
        change = rate - sums[:, 3] / sums[:, 2]
        out.append(("delta", float((edits - base) / chars), *map(float, np.percentile(change, [2.5, 97.5]))))
    return df.sparkSession.createDataFrame(out, "measure string, value double, low double, high double")


def binary_scores(df: DataFrame, truth: Column, guess: Column, by: list[str] | None = None) -> DataFrame:
    out = df.groupBy(*(by or [])).agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": _ratio(2 * p * r, p + r)})


def operation_counts(df: DataFrame, source: Column, target: Column) -> DataFrame:
    """(op, count) over all aligned token steps."""
    return df.select(F.explode(S.alignment(source, target)).alias("s")).groupBy(F.col("s.op").alias("op")).count()


def gate(summary: DataFrame, baseline: str, candidate: str, name: str = "condition") -> DataFrame:
    """One row: does the candidate pass?  Five comparisons with the baseline row.

    It corrects something, corrects better (F1), overcorrects less, has fewer
    word errors, and not more character errors.
    """
    sides = [summary.filter(F.col(name) == which).select(F.struct(*summary.columns).alias(side)) for side, which in (("a", baseline), ("b", candidate))]
    checks = {
        "some_corrections": F.col("b.correction_tp") > 0, "higher_correction_f1": F.col("b.correction_f1") > F.col("a.correction_f1"),
        "lower_overcorrection": F.col("b.overcorrection_rate") < F.col("a.overcorrection_rate"), "cer_not_worse": F.col("b.cer") <= F.col("a.cer"), "lower_wer": F.col("b.wer") < F.col("a.wer")}
    out = sides[0].withColumn("_k", F.lit(1)).join(sides[1].withColumn("_k", F.lit(1)), "_k").select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    return out.withColumn("passed", reduce(lambda x, y: x & y, [F.col(n) for n in checks]))


def rejoined(predictions: DataFrame, raw: DataFrame, key: str = "source_id", prediction: str = "prediction") -> DataFrame:
    """``raw`` with each row's prediction, one to one; a row without one raises."""
    audit.require_unique(raw, [key], "raw rows")
    audit.require_unique(predictions, [key], "predictions")
    joined = raw.join(predictions.select(key, prediction), key, "left")
    if joined.filter(F.col(prediction).isNull()).limit(1).count():
        raise ValueError("rows without a prediction")
    return joined


def stacked_scores(raw: DataFrame, conditions: dict[str, DataFrame | None], source: str = "source_text", reference: str = "target_text", key: str = "source_id") -> DataFrame:
    """One row of scores a condition, in one pass: None is the identity, else (key, prediction)."""
    parts = []
    for name, predictions in conditions.items():
        rows = raw.withColumn("prediction", F.col(source)) if predictions is None else rejoined(predictions, raw, key)
        parts.append(rows.select(F.lit(name).alias("condition"), source, reference, "prediction"))
    return scores(reduce(lambda a, b: a.unionByName(b), parts), "prediction", reference, source, ["condition"])


def corpus_profile(pairs: DataFrame, by: list[str], source: str = "source_text", target: str = "target_text") -> DataFrame:
    """Per condition: rows, changed rows, mean lengths, their ratio, and mean character and word edits."""
    changed = T.canonical_text(F.col(source)) != T.canonical_text(F.col(target))
    counted = row_counts(pairs, None, source, target)
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(changed).alias("changed_rows"), (100.0 * F.count_if(changed) / F.count(F.lit(1))).alias("changed_percent"),
        F.avg(F.length(source)).alias("source_chars_mean"), F.avg(F.length(target)).alias("target_chars_mean"),
        (F.sum(F.length(source)) / F.sum(F.length(target))).alias("length_ratio"), F.avg("char_edits").alias("character_edits_mean"), F.avg("word_edits").alias("word_edits_mean"))
