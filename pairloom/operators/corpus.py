"""The pretraining corpus: content selector, segments, leakage filters, splits; training sets."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import audit, order

#: The selector's feature and model settings.
SIZES, MIN_DOCS, MAX_FEATURES, STRENGTH, THRESHOLD = (3, 4, 5), 2, 60_000, 2.0, 0.80
SPLITS = {"train": 0.90, "dev": 0.05, "test": 0.05}


#: Characters whose n-grams are scored together.
BLOCK = 500_000


def word_grams(text: str | None) -> list[str]:
    """Character n-grams inside blank-padded lower-case words; a shorter word stands whole."""
    out = []
    for word in (text or "").lower().split():
        padded = f" {word} "
        for n in SIZES:
            out += [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]
            if len(padded) <= n:
                break
    return out


class Selector:
    """Weights of n-grams over sublinear, length-normalised tf-idf."""

    def __init__(self, idf: dict[str, float], weights: dict[str, float], bias: float):
        self.idf, self.weights, self.bias = idf, weights, bias
        self._codes: tuple | None = None

    def vector(self, text: str | None) -> dict[str, float]:
        counts = Counter(g for g in word_grams(text) if g in self.idf)
        raw = {g: (1 + math.log(n)) * self.idf[g] for g, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        return {g: v / norm for g, v in raw.items()}

    def probability(self, text: str | None) -> float:
        z = self.bias + sum(v * self.weights[g] for g, v in self.vector(text).items())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def _coded(self):
        """Codes of the n-grams' characters, the bits of one, and the n-grams as whole numbers; None if they pass 64 bits."""
        if self._codes is None:
            letters = sorted(set("".join(self.idf)))
            bits = len(letters).bit_length()
            codes = np.zeros(0x110000, np.uint16)
            if bits * max(SIZES) < 64:
                codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
                own = {c: i for i, c in enumerate(letters, 1)}
                keys = pa.array([sum(own[c] << bits * k for k, c in enumerate(g)) for g in self.idf], pa.int64())
                self._codes = codes, bits, keys, np.array(list(self.idf.values()), float), np.array([self.weights[g] for g in self.idf], float)
            else:
                self._codes = ()
        return self._codes

    def probabilities(self, texts: Iterable[str | None]) -> np.ndarray:
        """``probability`` of many texts: their n-grams are numbers that are looked up together."""
        if not self._coded():
            return np.array([self.probability(t) for t in texts], float)
        out, held, size = [np.zeros(0)], [], 0
        for text in texts:
            words = (text or "").lower().split()
            # two blanks between words stand in no n-gram
            held.append(f" {'  '.join(words)} " if words else "")
            size += len(held[-1])
            if size > BLOCK:
                out.append(self._block(held))
                held, size = [], 0
        return np.concatenate([*out, self._block(held)])

    def _block(self, texts: list[str]) -> np.ndarray:
        codes, bits, keys, idf, weights = self._coded()
        c = codes[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)].astype(np.int64)
        places, key = [], c
        for n in range(2, max(SIZES) + 1):
            last = c[n - 1 :]
            key = key[: len(last)] | last << bits * (n - 1)
            if n in SIZES:
                # without its last character, an n-gram would pass for a shorter one
                found = pc.index_in(pa.array(np.where(last == 0, 0, key)), value_set=keys)
                places.append(found.fill_null(-1).to_numpy(zero_copy_only=False) + 1)
        z, start = [], 0
        for text in texts:
            mine = np.concatenate([p[start : start + len(text)] for p in places])
            start += len(text)
            counts = np.bincount(mine, minlength=len(idf) + 1)[1:]
            at = np.flatnonzero(counts)
            value = (1 + np.log(counts[at])) * idf[at]
            z.append(self.bias + float((value * weights[at]).sum()) / (math.sqrt(float((value * value).sum())) or 1.0))
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, documents, total), summed up inside a batch."""
    for batch in batches:
        documents, total = Counter(), Counter()
        for text in batch.column(0).to_pylist():
            grams = Counter(word_grams(text))
            total.update(grams)
            documents.update(grams.keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([documents[g] for g in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["gram", "documents", "total"])


def fit_selector(labelled: DataFrame) -> Selector:
    """Balanced logistic regression on all rows of (text, label).

    Grams are counted and vectors made in the executors; only the features
    themselves (``MAX_FEATURES`` at most) come to the driver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = labelled.sparkSession
    rows = labelled.select("text", F.col("label").cast("int").alias("label"))
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < positive < n:
        raise ValueError("both classes are needed")
    counted = rows.select("text").mapInArrow(_gram_counts, "gram string, documents long, total long")
    counted = counted.groupBy("gram").agg(F.sum("documents").alias("documents"), F.sum("total").alias("total")).filter(F.col("documents") >= MIN_DOCS)
    known = counted.orderBy(F.desc("total"), "gram").limit(MAX_FEATURES).collect()
    selector = Selector({r["gram"]: math.log((1 + n) / (1 + r["documents"])) + 1 for r in known}, {}, 0.0)
    packed = spark.sparkContext.broadcast((selector.idf, {r["gram"]: i for i, r in enumerate(known)}))

    def vectors(part):
        idf, index = packed.value
        made = Selector(idf, {}, 0.0)
        for text, label in part:
            v = {index[g]: x for g, x in made.vector(text).items()}
            yield float(label), n / (2.0 * (positive if label else n - positive)), Vectors.sparse(len(index), v)

    schema = StructType([StructField("label", DoubleType()), StructField("weight", DoubleType()), StructField("features", VectorUDT())])
    data = spark.createDataFrame(rows.rdd.mapPartitions(vectors), schema)
    # the reference objective sums losses and halves the norm; Spark averages by weight, whose sum is n
    model = LogisticRegression(regParam=1.0 / (STRENGTH * n), standardization=False, weightCol="weight", maxIter=500, tol=1e-8).fit(data)
    selector.weights = dict(zip((r["gram"] for r in known), map(float, model.coefficients), strict=True))
    selector.bias = float(model.intercept)
    packed.unpersist()
    return selector


def select_score(text: Column, selector: Selector) -> Column:
    packed = (selector.idf, selector.weights, selector.bias)
    held: list[Selector] = []

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Selector(*packed))
        return pa.array(held[0].probabilities(texts.to_pylist()), pa.float64())

    return run(text)


def selector_audit(labelled: DataFrame, group: str = "document_id", rows: int | None = None, characters: int | None = None) -> DataFrame:
    """Leave-one-group-out precision, recall and F1 at the threshold (``folds``): fitted and scored on all
    labelled rows; ``rows`` and ``characters`` bound a block of texts, not the input."""
    from . import folds

    return folds.audit_scores(labelled, group, rows or folds.ROWS, characters or folds.CHARACTERS)


def segments(df: DataFrame, prefix: str, domain: str, row: str, document: str, limit: int = 240) -> DataFrame:
    """(source_id, domain, document_id, segment_index, text, ordinal, canonical, compact) of normalised texts."""
    each = df.select("*", F.posexplode(T.segment_text(F.col("text"), limit, collapsed=True)).alias("segment_index", "segment"))
    out = each.select(
        F.concat_ws(":", F.lit(prefix), F.col(row).cast("string"), F.col("segment_index").cast("string")).alias("source_id"), F.lit(domain).alias("domain"),
        F.col(document).cast("string").alias("document_id"), "segment_index", F.col("segment").alias("text"), F.struct(F.col(row).alias("row"), "segment_index").alias("ordinal"),
        *([F.col("selector_score")] if "selector_score" in df.columns else [F.lit(None).cast("double").alias("selector_score")]))
    # a piece of a normalised text is normalised
    return out.withColumn("canonical", T.casefold(F.col("text"))).withColumn("compact", F.regexp_replace("canonical", "[^\\p{L}\\p{N}]+", ""))


def without_gold(df: DataFrame, gold: DataFrame) -> DataFrame:
    return audit.anti_keys(df, gold, [(F.col("canonical"), "canonical"), (F.col("compact"), "compact")])


def build_corpus(comments: DataFrame, news: DataFrame, gold: DataFrame, gold_documents: DataFrame, selector: Selector | None = None,
                 threshold: float = THRESHOLD, seed: int = 2026) -> DataFrame:
    """Comments and news as deduplicated, leak-free, document-split segments.

    ``comments``: row, text, document; ``news``: row, text, document; ``gold``:
    text; ``gold_documents``: document.  News win over comments on equal text.
    """
    from ..sources.shared import cut

    keys = gold.select(T.canonical_text(F.col("text")).alias("canonical")).withColumn("compact", F.regexp_replace("canonical", "[^\\p{L}\\p{N}]", "")).distinct()
    ours = comments.join(gold_documents.select("document").distinct(), "document", "left_anti").withColumn("text", T.normalized_once(F.col("text"))).filter(T.usable_text(F.col("text")))
    ours = ours.withColumn("canonical", T.casefold(F.col("text"))).withColumn("compact", F.regexp_replace("canonical", "[^\\p{L}\\p{N}]", ""))
    ours = without_gold(ours, keys)
    if selector is not None:
        ours = ours.withColumn("selector_score", select_score(F.col("text"), selector)).filter(F.col("selector_score") >= threshold)
    informal = segments(ours, "comment", "informal", "row", "document")
    formal = segments(news.withColumn("text", T.normalized_once(F.col("text"))), "news", "formal", "row", "document").filter(T.usable_text(F.col("text")))
    # written once: the splits below read it several times
    both = cut(order.union_keep_first([without_gold(formal, keys), without_gold(informal, keys)], ["canonical"], ["ordinal"]).drop("compact"))
    parts = [order.assign_group_splits(both.filter(F.col("domain") == d), "document_id", SPLITS, seed) for d in ("formal", "informal")]
    return parts[0].unionByName(parts[1]).drop("ordinal")


def assemble_training(synthetic: DataFrame | None, gold: DataFrame | None, regime: str, seed: int = 2026) -> DataFrame:
    """Training pairs of a regime, gold first on equal pairs, in keyed order."""
    wanted = {"synthetic_only": [synthetic], "gold_only": [gold], "synthetic_plus_gold": [gold, synthetic]}.get(regime.lower())
    if wanted is None or any(x is None for x in wanted):
        raise ValueError(f"regime {regime} lacks its data")
    keyed = [x.withColumns({"_s": T.pair_key(F.col("source_text")), "_t": T.pair_key(F.col("target_text"))}) for x in wanted]
    return order.union_keep_first(keyed, ["_s", "_t"], ["source_id"]).drop("_s", "_t").orderBy(order.hash_rank(seed, F.col("source_id")), "source_id")


def matched_sets(methods: DataFrame, number: int, size: int, seed: int = 2026) -> DataFrame:
    """The same ``size`` targets for all ``number`` methods: (method, source_text, target_text, key)."""
    keyed = methods.withColumn("key", F.hex(order.key_digest(T.pair_key(F.col("target_text")))))
    first = order.keep_first(keyed, ["method", "key"], ["source_id"])
    common = order.sample_rows(order.common_keys(first, "key", "method", number), "key", size, seed)
    return first.join(F.broadcast(common) if size <= 200_000 else common, "key")


def dataset_status(frames: dict[str, DataFrame], key: str = "source_id") -> DataFrame:
    """(method, rows, distinct_ids, ready): one aggregate a data set."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_ids")).withColumn("method", F.lit(m)) for m, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("method", "rows", "distinct_ids", ((F.col("rows") > 0) & (F.col("rows") == F.col("distinct_ids"))).alias("ready"))


def foreign_ratio(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """(key, ratio): share of a text's plain words that a foreign word list holds."""
    each = df.select(key, F.explode_outer(F.split(T.collapse(F.lower(F.regexp_replace(T.blank(F.col(text)), "[^a-zA-ZÀ-ÿ\\s]", ""))), " ")).alias("word"))
    listed = words.select(F.lower("word").alias("word")).distinct().withColumn("_in", F.lit(1))
    return each.join(listed, "word", "left").groupBy(key).agg(F.coalesce(F.sum("_in") / F.count_if(F.col("word") != ""), F.lit(0.0)).alias("ratio"))


def filtered_comments(df: DataFrame, key: str, text: str, words: DataFrame, least_words: int = 3, most_foreign: float = 0.5) -> DataFrame:
    """(key, cleaned, ratio): comments that survive cleaning, in this order: something is
    left, it has ``least_words`` words, some of them letters, and fewer than
    ``most_foreign`` of those are foreign."""
    cleaned = df.select(key, T.clean_comment(F.col(text)).alias("cleaned")).filter((F.col("cleaned") != "") & (F.size(F.split("cleaned", " ")) >= least_words))
    lettered = cleaned.filter(F.col("cleaned").rlike("[a-zA-ZÀ-ÿ]"))
    return lettered.join(foreign_ratio(lettered, key, "cleaned", words), key).filter(F.col("ratio") < most_foreign)
