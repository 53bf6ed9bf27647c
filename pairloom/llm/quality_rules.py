r"""Quality rules judged at host level.

Every document is measured once (an Arrow function returning numbers only).
The failures of each rule are summed per host, the failure rates are shrunk
towards a beta prior fitted to all hosts by moments, and the host's verdicts
are joined back:

* a document that fails a base rule goes, on any host;
* a host is strict for a soft rule if its posterior rate for that rule, or for
  the base rules, lies above the prior's mean with a probability of 90 % (its
  mean less ``QUANTILE`` standard deviations does); on a strict host the
  documents that fail the soft rule go too;
* with a ``block_rate``, a host whose shrunk base-failure rate reaches it goes
  as a whole.  By default it is off, so documents that fail no rule stay.

Defined results: a null or empty text has no words and fails the base rule; a
null host has no verdict of its own, so its documents are judged by the base
rules alone; repeated rows are judged each; an empty table gives an empty
table; extra columns of any name are passed by.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import ASCII_SPACE, materialize, size_checked, small_batches

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Standard deviations between a mean and the bound that a normal variable exceeds with 90 %.
QUANTILE = 1.2815515655446004
#: Soft rules: name -> (percent limit, numerator, denominator).
SOFT_RULES = {
    "symbols": (10, "n_symbols", "word_chars"),
    "dup_lines": (30, "n_dup_lines", "n_lines"),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeated_words(docs: list[list[bytes]]) -> np.ndarray:
    """Words of each document that lie in 8-word windows found twice or more in it.

    Windows are compared exactly: words get integer codes, and codes of pairs,
    fours and eights are made from the codes of their halves.
    """
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    total = int(lengths.sum())
    out = np.zeros(len(docs), dtype=np.int64)
    if total < 2 * 1 + WINDOW - 1:
        return out
    flat = np.empty(total, dtype=object)
    at = 0
    for d in docs:
        flat[at : at + len(d)] = d
        at += len(d)
    owner = np.repeat(np.arange(len(docs)), lengths)
    codes = pd.factorize(flat)[0].astype(np.int64)
    width = 1
    while width < WINDOW:
        n = len(codes) - width
        if n <= 0:
            return out
        codes = pd.factorize(codes[:n] * (int(codes.max()) + 1) + codes[width : width + n])[0].astype(np.int64)
        width *= 2
    starts = np.nonzero(owner[: len(codes)] == owner[WINDOW - 1 : WINDOW - 1 + len(codes)])[0]
    if not len(starts):
        return out
    keys = pd.factorize(codes[starts] * len(docs) + owner[starts])[0]
    twice = starts[np.bincount(keys)[keys] > 1]
    marks = np.zeros(total + 1, dtype=np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + WINDOW, -1)
    covered = np.cumsum(marks[:-1]) > 0
    np.add.at(out, owner[covered], 1)
    return out


def measure_texts(texts: list[str | None], chunk: int = 2 << 20) -> dict[str, np.ndarray]:
    """The measures of a list of texts, worked off in chunks of some MB."""
    out = {k: np.zeros(len(texts), dtype=np.int64) for k in MEASURES}
    words: list[list[bytes]] = []
    first = held = 0

    def close(end: int) -> None:
        nonlocal words, first, held
        if words:
            out["n_repeat_words"][first:end] = repeated_words(words)
        words, first, held = [], end, 0

    for i, text in enumerate(texts):
        text = text or ""
        found = text.encode("utf-8", "surrogatepass").split()  # bytes.split() takes ASCII white space only
        words.append(found)
        held += len(text)
        lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
        out["n_words"][i] = len(found)
        out["word_chars"][i] = len(text) - sum(text.count(c) for c in ASCII_SPACE)
        out["n_symbols"][i] = sum(text.count(c) for c in SYMBOLS)
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        if held >= chunk:
            close(i + 1)
    close(len(texts))
    return out


def _measure_column():
    kind = StructType([StructField(k, LongType()) for k in MEASURES])

    @F.arrow_udf(kind)
    def measures(texts: pa.Array) -> pa.Array:
        got = measure_texts(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(got[k]) for k in MEASURES], names=MEASURES)

    # else a filter on the verdict is pushed down with a second copy of the measuring
    return measures.asNondeterministic()


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def soft_failed(rule: str):
    percent, part, whole = SOFT_RULES[rule]
    return 100 * F.col(part) > percent * F.col(whole)


def beta_prior(rates: list[tuple[float, float, int]]) -> tuple[float, float]:
    """Moments of the hosts' rates -> (a, b).  ``rates``: one (mean, variance, hosts)."""
    mean, var, hosts = rates[0]
    if not hosts:
        return 1.0, 1.0
    mean = min(max(mean, 1e-4), 1 - 1e-4)
    var = min(max(var or 0.0, 1e-6), mean * (1 - mean) * 0.99)
    weight = max(2.0, mean * (1 - mean) / var - 1)
    return mean * weight, (1 - mean) * weight


def host_verdicts(measured: DataFrame, host: str, block_rate: float | None = None, quantile: float = QUANTILE) -> DataFrame:
    """One row a host: documents, shrunk failure rates, and the verdict of each rule."""
    rules = {"base": base_failed(), **{r: soft_failed(r) for r in SOFT_RULES}}
    counts = measured.filter(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("host_docs"),
        *[F.sum(c.cast("long")).alias(f"failed_{r}") for r, c in rules.items()],
    )
    counts = materialize(counts)
    moments = counts.agg(
        F.count(F.lit(1)).alias("hosts"),
        *[x for r in rules for x in (
            (F.sum(f"failed_{r}") / F.sum("host_docs")).alias(f"mean_{r}"),
            F.var_pop(F.col(f"failed_{r}") / F.col("host_docs")).alias(f"var_{r}"),
        )],
    ).first()
    for r in rules:
        a, b = beta_prior([(moments[f"mean_{r}"], moments[f"var_{r}"], moments["hosts"])])
        rate = (F.col(f"failed_{r}") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
        deviation = F.sqrt(rate * (1 - rate) / (F.col("host_docs") + F.lit(a + b + 1)))
        counts = counts.withColumns({f"rate_{r}": rate, f"above_{r}": rate - F.lit(quantile) * deviation > F.lit(a / (a + b))})
    return counts.select(
        F.col(host).alias("_host"), "host_docs", *[f"rate_{r}" for r in rules],
        (F.lit(False) if block_rate is None else F.col("rate_base") >= block_rate).alias("host_blocked"),
        *[(F.col("above_base") | F.col(f"above_{r}")).alias(f"strict_{r}") for r in SOFT_RULES],
    )


def with_verdicts(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``measured`` (with ``_host`` and the measures) plus a struct ``quality``.

    The hosts' table is broadcast only if its counted rows allow it, else the
    join is salted so that a host with a third of all rows meets many tasks.
    """
    hosts, small = size_checked(verdicts)
    if small:
        joined = measured.join(hosts, "_host", "left")
    else:
        spread = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = measured.withColumn("_salt", F.pmod(F.xxhash64(*MEASURES), F.lit(64)).cast("int")).join(spread, ["_host", "_salt"], "left").drop("_salt")
    failed = base_failed()
    strict = F.lit(False)
    for r in SOFT_RULES:
        strict = strict | (F.coalesce(F.col(f"strict_{r}"), F.lit(False)) & soft_failed(r))
    kept = ~failed & ~F.coalesce(F.col("host_blocked"), F.lit(False)) & ~strict
    return joined.withColumn("quality", F.struct(
        *MEASURES, failed.alias("base_failed"), F.col("rate_base").alias("host_rate"), kept.alias("kept"), (~failed & ~kept).alias("host_rejected")))


def _measured(docs: DataFrame, text: str, host: str, keep: list[str]) -> DataFrame:
    """``_row`` (the kept columns), ``_host`` and the measures."""
    small_batches(docs.sparkSession)
    held = F.struct(*[F.col(c) for c in keep]).alias("_row") if keep else F.lit(None).alias("_row")
    measured = docs.select(held, F.col(host).cast("string").alias("_host"), _measure_column()(F.col(text)).alias("_m"))
    return measured.select("_row", "_host", "_m.*")


def judge(docs: DataFrame, text: str = "text", host: str = "source", block_rate: float | None = None, quantile: float = QUANTILE) -> DataFrame:
    """``_row`` (the columns of ``docs``) and a struct ``quality``: the measures,
    ``base_failed``, the host's shrunk rate, ``kept`` and ``host_rejected``
    (the host's verdict alone made it go).

    Texts are measured twice, once for the hosts and once for the verdicts, so
    that no text has to be written down in between.
    """
    verdicts = host_verdicts(_measured(docs, text, host, []).drop("_row"), "_host", block_rate, quantile)
    return with_verdicts(_measured(docs, text, host, docs.columns), verdicts).select("_row", "quality")


def quality_rows(docs: DataFrame, block_rate: float | None = None, quantile: float = QUANTILE) -> DataFrame:
    """The contract's columns, one row a document; numbers are written once and used twice."""
    measured = materialize(_measured(docs, "text", "source", ["doc_id"]))
    out = with_verdicts(measured, host_verdicts(measured, "_host", block_rate, quantile))
    return out.select(
        "_row.doc_id", *[f"quality.{k}" for k in MEASURES if k != "n_lines"], "quality.base_failed", "quality.kept", F.round("quality.host_rate", 9).alias("host_rate"), "quality.host_rejected")


def keep_good(docs: DataFrame, block_rate: float | None = None, quantile: float = QUANTILE) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judge(docs, block_rate=block_rate, quantile=quantile).filter("quality.kept").select("_row.*")
