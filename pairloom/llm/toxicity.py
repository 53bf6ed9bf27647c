r"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in the
summed weights of its words, and the document's probability is the noisy-or of
its sentences.  Only document labels are needed to fit the weights; the fitted
sentence probabilities then locate the offending sentences.

Words are lower-cased runs of letters; each brings itself and its leading 4, 5
and 6 letters.  The model is fitted in the driver on a bounded sample of
labelled rows (``TRAIN_DOCS`` rows and ``TRAIN_CHARS`` characters at most, in
the order of a keyed hash of the id); scoring runs over every whole text in an
Arrow function.  No column but the text enters a score.

Defined results: a null or empty text, or one without known words, scores the
fitted leak; repeated rows score alike; without usable labels, or with one
class only, every text scores the smoothed share of positive labels; empty
tables give an empty table; extra columns of any name are passed by.  If an id
repeats with other texts, the least text is the one that is fitted.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches

TRAIN_DOCS, TRAIN_CHARS = 6_000, 32_000_000
FEATURES, MIN_DOCS, STEPS, L2, LEAK = 3_000, 4, 300, 0.02, 0.02
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_END = re.compile(r"[.!?\n]")
_ENDS = ".!?\n"
_MEMO_WORDS = 400_000


def features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in (4, 5, 6) if len(word) >= k)]


class Model:
    """Weights of features, the bias of a sentence, and the leak of a document."""

    def __init__(self, weights: dict[str, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak
        self.memo: dict[str, float | None] = {}

    def weight(self, word: str) -> float | None:
        """Summed weight of a word; None if none of its features is known."""
        if word not in self.memo:
            if len(self.memo) > _MEMO_WORDS:
                self.memo.clear()
            known = [self.weights[f] for f in features(word) if f in self.weights]
            self.memo[word] = sum(known) if known else None
        return self.memo[word]

    def sentences(self, text: str | None) -> list[tuple[int, float]]:
        """(number, probability) of the sentences that hold known words."""
        out: list[tuple[int, float]] = []
        number, total, some = 0, self.bias, False
        memo, weight = self.memo, self.weight
        for token in _TOKEN.findall((text or "").lower()):
            if token in _ENDS:
                if some:
                    out.append((number, total))
                    total, some = self.bias, False
                number += 1
                continue
            w = memo[token] if token in memo else weight(token)
            if w is not None:
                total += w
                some = True
        if some:
            out.append((number, total))
        return [(i, 1.0 / (1.0 + float(np.exp(-min(max(z, -30.0), 30.0))))) for i, z in out]

    def score(self, sentences: list[tuple[int, float]]) -> float:
        clean = 1.0 - self.leak
        for _, p in sentences:
            clean *= 1.0 - p
        return min(1.0, max(0.0, 1.0 - clean))


def fit(rows: list[tuple[str, int]]) -> Model:
    """Fit on (text, label 0/1)."""
    positive = sum(y for _, y in rows)
    if not positive or positive == len(rows):
        return Model({}, 0.0, (positive + 0.5) / (len(rows) + 5.0))
    bags = [[[t for t in re.findall(r"[^\W\d_]+", s)] for s in _END.split((text or "").lower())] for text, _ in rows]
    seen = [Counter(), Counter()]
    for bag, (_, y) in zip(bags, rows, strict=True):
        seen[y].update({f for s in bag for w in set(s) for f in features(w)})
    negative = len(rows) - positive
    ranked = []
    for f in set(seen[0]) | set(seen[1]):
        a, b = seen[1][f], seen[0][f]
        if a + b >= MIN_DOCS:
            gap = a / positive - b / negative
            share = (a + b) / len(rows)
            ranked.append((-gap * gap / (share * (1 - share) + 1e-6), f))
    index = {f: i for i, (_, f) in enumerate(sorted(ranked)[:FEATURES])}
    columns, sentence_of, doc_of = [], [], []
    for d, bag in enumerate(bags):
        for words in bag:
            got = [index[f] for w in words for f in features(w) if f in index]
            if got:
                columns += got
                sentence_of += [len(doc_of)] * len(got)
                doc_of.append(d)
    col, sent, doc = np.array(columns, np.int64), np.array(sentence_of, np.int64), np.array(doc_of, np.int64)
    y = np.array([y for _, y in rows], float)
    theta = np.zeros(len(index) + 1)
    theta[-1] = -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = np.clip(theta[-1] + np.bincount(sent, theta[col], minlength=len(doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = (1 - LEAK) * np.exp(-np.bincount(doc, np.logaddexp(0, z), minlength=len(y)))
        bag_p = np.clip(1 - clean, 1e-9, 1)
        pull = np.where(y == 1, -clean / bag_p, 1.0)
        dz = pull[doc] * p
        grad = np.append(np.bincount(col, dz[sent], minlength=len(index)) + L2 * theta[:-1], dz.sum() + 1e-3 * theta[-1])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in index.items()}, float(theta[-1]), LEAK)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> list[tuple[str, int]]:
    """The bounded sample: ids and lengths first, then the chosen texts."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    ids = F.broadcast(chosen)  # TRAIN_DOCS rows at most
    sizes = docs.select("doc_id", F.length("text").alias("n")).join(ids, "doc_id").groupBy("doc_id").agg(
        F.max("n").alias("n"), F.max("_y").alias("y"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()
    room, labels_of = TRAIN_CHARS, {}
    for r in sizes:
        if (r["n"] or 0) <= room:
            room -= r["n"] or 0
            labels_of[r["doc_id"]] = int(r["y"])
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in labels_of], "doc_id long"))
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return sorted((r["text"] or "", labels_of[r["doc_id"]]) for r in texts.collect())


RESULT = "struct<score:double,sentences:array<struct<start:bigint,end:bigint,score:double>>>"


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus a struct ``toxicity`` (or the first free ``toxicity_N``): the score, and the offending sentences with offsets."""
    small_batches(docs.sparkSession)
    packed = (model.weights, model.bias, model.leak)
    kind = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])
    held: list[Model] = []  # one model a worker

    @F.arrow_udf(RESULT)
    def scored(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Model(*packed))
        rows = []
        for value in texts.to_pylist():
            found = held[0].sentences(value)
            bad = [(i, p) for i, p in found if p >= THRESHOLD]
            ends = [m.start() for m in _END.finditer(value)] if bad else []
            rows.append({"score": held[0].score(found), "sentences": [
                {"start": ends[i - 1] + 1 if i else 0, "end": ends[i] + 1 if i < len(ends) else len(value), "score": p} for i, p in bad]})
        return pa.array(rows, kind)

    return docs.withColumn(free_name(docs, "toxicity"), scored(F.col(text)))


def toxicity_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, plus the number and the offsets of the offending sentences."""
    model = fit(training_rows(docs, labels))
    out = score_texts(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= THRESHOLD).cast("int").alias("predicted"), F.size("toxicity.sentences").alias("n_sentences"),
        F.array_join(F.transform("toxicity.sentences", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias("sentence_spans"))
