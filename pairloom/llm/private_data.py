r"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

1. One scan over the texts gives the base spans of four kinds (email, ip, card,
   phone), which are the seeds, and the other runs of words that look like
   identifiers; each with 64-bit keys of the contexts around it.
2. Contexts that stand around ``MIN_SEEDS`` different seeds of a kind are
   patterns: one, two or three words before, one before and one after, or two
   after the slot.  A second scan counts the plain words in the patterns'
   slots; a bitmap of fixed size says which contexts to count, and the exact
   join with the patterns follows.
3. The graph of patterns and instances is scored for ``ROUNDS`` rounds of joins:
   a pattern's score is the part of its slot fillers that are identifiers, each
   weighted by its own score; an instance's score is the noisy-or over the
   best pattern of each family (before, around, after); seeds keep the score 1.
4. Identifiers in the slot of a pattern that scores ``CONFIDENT`` or more are
   added to the spans, with the pattern's kind.

What is shuffled are keys and offsets, never texts.  Context keys of two
contexts collide with odds of n*n / 2**65.

Base patterns are matched leftmost and without overlaps within a kind, in
linear time; a match that fails its check (parts at most 255, 13 to 19 digits
with a valid Luhn sum, 9 to 15 digits) is dropped without another try.

Defined results: a null text is empty and has no spans; repeated rows are
scanned each, but count as one instance; ties between kinds go to the first
listed; an empty table gives an empty table; extra columns of any name are
passed by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Different seeds that a pattern needs, and what it must score.
MIN_SEEDS, CONFIDENT = 3, 0.7
ROUNDS = 3
#: Words and letters or digits of a run that looks like an identifier.
RUN_WORDS, RUN_CHARS = 6, 5
#: Bits of the map of the patterns' contexts: 2 MB whatever the number of patterns.
MAP_BITS = 24
#: Words that a task hashes at once (a text more), and counted contexts that it holds.
WORDS_AT_ONCE, HELD = 200_000, 2_000_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Words; what ends with a colon or an equals sign is a label of its own.
_WORD = re.compile(r"[^\x20\x09-\x0D:=]+[:=]*|[:=]+")
_EDGES = "\"'`()[]{}<>,.;:!?=*|"

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Every ``@`` with a domain after it; the local part reaches back as far as it may."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        local = text[done:at]
        n = len(local) - len(local.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if n else None
        if domain:
            out.append((at - n, domain.end()))
            done = domain.end()
        else:
            done = max(done, at)  # nothing may reach back over an @
        at = text.find("@", max(at + 1, done))
    return out


def addresses(text: str) -> list[Span]:
    """Groups of four parts of a chain of dotted numbers, from its left end."""
    out = []
    for chain in _CHAIN.finditer(text):
        parts, at, ends = chain.group().split("."), chain.start(), []
        for p in parts:
            ends.append((at, at + len(p)))
            at += len(p) + 1
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                out.append((ends[i][0], ends[i + 3][1]))
    return out


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]


def base_spans(text: str) -> list[list[Span]]:
    """The spans of each kind, in the order of ``KINDS``."""
    digits = _DIGIT.search(text) is not None
    return [
        emails(text) if "@" in text else [], addresses(text) if digits else [], cards(text) if digits else [], phones(text) if digits and "+" in text else []]


def _normal(word: str) -> str:
    return _DIGIT.sub("0", word).lower()


def word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of normalised words, and which words are plain (no identifiers); each different word is looked at once."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    flat = np.empty(len(words), dtype=object)
    flat[:] = words
    codes, different = pd.factorize(flat)
    plain = np.array([not _looks_like(w) for w in different])
    normal = np.empty(len(different), dtype=object)
    normal[:] = [w.lower() if p else _normal(w) for w, p in zip(different, plain)]
    return pd.util.hash_array(normal, categorize=False)[codes], plain[codes]


#: Stand before the first and after the last word; no word has a line end.
_START, _END = ["\n<"] * 3, ["\n>"] * 2


def _framed(words: list[str]) -> list[str]:
    return _START + words + _END


#: Families of contexts in the order of their keys: three before, one around, one after.
FAMILIES = (0, 0, 0, 1, 2)


def _mix(seed: int, *parts: np.ndarray) -> np.ndarray:
    """One 64-bit key a row from the hashes of its parts (multiply, shift, add)."""
    out = np.full(len(parts[0]), seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(32)
    return out


def context_keys(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of the five contexts of slots that reach from place ``first`` to place ``last`` of framed words; a row a slot."""
    before, after = [hashes[first - k] for k in (1, 2, 3)], [hashes[last + k] for k in (1, 2)]
    keys = [_mix(1, before[0]), _mix(2, before[1], before[0]), _mix(3, before[2], before[1], before[0]), _mix(4, before[0], after[0]), _mix(5, after[0], after[1])]
    return np.stack(keys, axis=1).view(np.int64)


def _looks_like(word: str) -> bool:
    return "@" in word or _DIGIT.search(word) is not None


def _runs(words: list[re.Match], taken: list[Span]) -> list[tuple[int, int]]:
    """Runs of words (first and last index) that look like identifiers and touch no base span."""
    out: list[list[int]] = []
    at = 0
    for i, w in enumerate(words):
        while at < len(taken) and taken[at][1] <= w.start():
            at += 1
        free = at == len(taken) or taken[at][0] >= w.end()
        if not (free and _looks_like(w.group())):
            continue
        if out and out[-1][1] == i - 1 and i - out[-1][0] < RUN_WORDS:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(a, b) for a, b in out]


def _slots(text: str, spans: list[list[Span]]) -> tuple[list[tuple], np.ndarray]:
    """Seeds and other identifiers of a text as (kind or -1, start, end, content), and their contexts' keys."""
    words = list(_WORD.finditer(text))
    starts = np.array([w.start() for w in words])
    taken = sorted(s for kind in spans for s in kind)
    free_of: list[Span] = []
    for s in taken:  # spans of different kinds may overlap
        if free_of and s[0] < free_of[-1][1]:
            free_of[-1] = (free_of[-1][0], max(s[1], free_of[-1][1]))
        else:
            free_of.append(s)
    found, first, last = [], [], []
    for k, kind in enumerate(spans):
        for s, e in kind:
            found.append((k, s, e, text[s:e].lower()))
            first.append(int(np.searchsorted(starts, s, "right")) - 1)
            last.append(int(np.searchsorted(starts, e, "left")) - 1)
    for a, b in _runs(words, free_of):
        s, e = words[a].start(), words[b].end()
        whole = text[s:e]
        s, e = s + len(whole) - len(whole.lstrip(_EDGES)), e - len(whole) + len(whole.rstrip(_EDGES))
        if sum(map(str.isalnum, text[s:e])) >= RUN_CHARS:
            found.append((-1, s, e, text[s:e].lower()))
            first.append(a)
            last.append(b)
    if not found:
        return [], np.zeros((0, len(FAMILIES)), np.int64)
    return found, context_keys(word_hashes(_framed([w.group() for w in words]))[0], np.array(first) + 3, np.array(last) + 3)


_SPANS = "array<struct<kind:int,start:int,end:int>>"
_SCANNED = f"row bigint, base {_SPANS}, slots array<struct<kind:int,start:int,end:int,content:bigint,keys:array<bigint>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    slot = pa.struct([*span, pa.field("content", pa.int64()), pa.field("keys", pa.list_(pa.int64()))])
    for batch in batches:
        base, slots = [], []
        for body in batch.column("text"):
            text = body.as_py()
            spans = base_spans(text)
            base.append([{"kind": k, "start": s, "end": e} for k, kind in enumerate(spans) for s, e in kind])
            found, keys = _slots(text, spans) if _looks_like(text) else ([], None)
            contents = pd.util.hash_array(np.array([f[3] for f in found], dtype=object), categorize=False).view(np.int64).tolist() if found else []
            slots.append([{"kind": f[0], "start": f[1], "end": f[2], "content": c, "keys": list(k)} for f, c, k in zip(found, contents, keys.tolist() if found else [])])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(base, pa.list_(span)), pa.array(slots, pa.list_(slot))], ["row", "base", "slots"])


def _bitmap(patterns: DataFrame) -> np.ndarray:
    """A map of ``2**MAP_BITS`` bits with the patterns' keys; its size does not grow with them."""
    place = F.col("ctx").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = patterns.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast((ctx & {(1 << MAP_BITS) - 1}) & 63 as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()  # at most 2**(MAP_BITS - 6) rows
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def plain_counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``ctx, plain``: how often words that do not look like identifiers fill the patterns' slots."""
    known = texts.sparkSession.sparkContext.broadcast(_bitmap(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size, words = known.value, [], 0, []

        def count() -> int:
            hashes, plain = word_hashes(words)
            at = np.nonzero(plain & np.fromiter((w[0] != "\n" for w in words), bool, len(words)))[0]
            keys = context_keys(hashes, at, at).ravel()
            place = keys.view(np.uint64) & np.uint64((1 << MAP_BITS) - 1)
            held.append(keys[(bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1])
            words.clear()
            return len(held[-1])

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["ctx", "plain"])
                held.clear()

        for batch in batches:
            for body in batch.column("text"):
                words += _framed(_WORD.findall(body.as_py()))
                if len(words) > WORDS_AT_ONCE:
                    size += count()
                if size > HELD:
                    yield from flush()
                    size = 0
        if words:
            count()
        yield from flush()

    counted = texts.select("text").mapInArrow(run, "ctx bigint, plain bigint").groupBy("ctx").agg(F.sum("plain").alias("plain"))
    return counted.join(patterns.select("ctx").distinct(), "ctx", "left_semi")


def learned_patterns(scanned: DataFrame, texts: DataFrame, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """The patterns that score ``confident``: ``ctx, kind, score``."""
    edges = scanned.select(F.explode("slots").alias("s")).select("s.kind", "s.content", F.posexplode("s.keys").alias("place", "ctx"))
    edges = materialize(edges.distinct())  # an instance counts once a context, however often it stands there
    seeds = edges.filter("kind >= 0").groupBy("ctx", "kind").agg(F.count(F.lit(1)).alias("seeds"), F.first("place").alias("place")).filter(F.col("seeds") >= min_seeds)
    patterns = materialize(seeds)
    if patterns.isEmpty():
        return patterns.select("ctx", "kind", F.lit(1.0).alias("score"))
    slots = edges.select("ctx", "content").distinct().join(patterns.select("ctx").distinct(), "ctx", "left_semi")
    fillers = slots.groupBy("ctx").agg(F.count(F.lit(1)).alias("known")).join(plain_counts(texts, patterns), "ctx", "left")
    total = F.col("known") + F.coalesce(F.col("plain"), F.lit(0))
    # with all its identifiers true, a pattern cannot score more than this
    patterns = patterns.join(fillers, "ctx").withColumn("total", total).filter(F.col("known") >= confident * F.col("total"))
    patterns = materialize(patterns.select("ctx", "kind", "place", "seeds", "total"))
    family = F.element_at(F.array(*[F.lit(x) for x in FAMILIES]), F.col("place") + 1).alias("family")
    slots = materialize(edges.select("ctx", "content").distinct().join(patterns.select("ctx", "kind", family), "ctx"))
    own = materialize(edges.filter("kind >= 0").select("content", "kind", F.lit(1.0).alias("weight")).distinct())
    weights = own
    for _ in range(rounds):
        summed = slots.join(weights, ["content", "kind"]).groupBy("ctx", "kind").agg(F.sum("weight").alias("mass"))
        scores = materialize(patterns.join(summed, ["ctx", "kind"]).select("ctx", "kind", (F.col("mass") / (F.col("total") + 1)).alias("score")))
        best = slots.join(scores, ["ctx", "kind"]).groupBy("content", "kind", "family").agg(F.max("score").alias("score"))
        found = best.groupBy("content", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("weight"))
        weights = materialize(found.join(own.select("content", "kind"), ["content", "kind"], "left_anti").unionByName(own))
    return scores.filter(F.col("score") >= confident)


def private_spans(docs: DataFrame, text: str = "text", min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """The columns of ``docs`` but the text, and ``base`` and ``added``: arrays of (kind, start, end),
    the kind as its place in ``KINDS``, sorted by kind and start (free names if taken)."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    numbered = docs.select(*others, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # kept columns travel as one struct beside the scan's result
    held = numbered.select(F.struct(*others).alias("held"), F.col("_text").alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = held.schema["held"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (out,) = _scan(iter([batch.select(["row", "text"])]))
            yield pa.RecordBatch.from_arrays([batch.column("held"), *out.columns], ["held", "row", "base", "slots"])

    scanned = materialize(held.mapInArrow(run, f"held {kind}, {_SCANNED}"))
    patterns = learned_patterns(scanned, texts, min_seeds, confident, rounds)
    free = scanned.select("row", F.explode("slots").alias("s")).filter("s.kind < 0").select("row", "s.start", "s.end", F.explode("s.keys").alias("ctx"))
    choice = F.max(F.struct("score", (-F.col("kind")).alias("less"))).alias("best")
    added = free.join(patterns, "ctx").groupBy("row", "start", "end").agg(choice)
    added = added.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("best.less")).cast("int").alias("kind"), "start", "end"))).alias("added"))
    base, more = free_name(docs, "base"), free_name(docs, "added")
    return scanned.join(added, "row", "left").select("held.*", F.col("base").alias(base), F.coalesce("added", F.array().cast(_SPANS)).alias(more))


def _listed(spans) -> object:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def private_rows(docs: DataFrame) -> DataFrame:
    """The contract's columns, and ``n_added``: spans that the contexts found."""
    found = private_spans(docs.select("doc_id", "text"))

    def count(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select(
        "doc_id", *map(count, range(len(KINDS))), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"))
