r"""Benchmark decontamination with one Aho-Corasick automaton.

A-Z are lower-cased and words are runs of ``[0-9a-z]`` and non-ASCII
characters.  A benchmark item gives all its windows of 13 consecutive words,
or itself as one window if it is shorter.  The automaton runs over word codes:
each text is scanned once, and an occurrence is known by the index of its last
word, from which the offsets in the original text follow.

Thirteen-word windows share most of their words, so the automaton does not
hold each of them: it holds every seventh run of seven words of an item.  Any
window contains one of these runs whole; where one is found, the match is
extended to both sides over the item's words, and it counts if it is thirteen
words long.  That finds the same windows with a thirteenth of the nodes.

The benchmark travels with the function.  Items are dealt to groups of at most
``GROUP_CHARS`` characters, a worker builds each group's automaton once and
keeps it, and the groups add to the same result columns; nothing is shuffled.

Defined results: null has no words; a text without words is not contaminated;
items without words have no window; items with a null id mark words but are
not counted in ``n_items``; repeated rows are judged each; an empty benchmark
marks nothing; extra columns of any name are passed by.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches

#: Words of a window, and of the runs that the automaton holds: WINDOW = 2 * RUN - 1.
WINDOW, RUN = 13, 7
GROUP_CHARS = 16 << 20
#: Bytes that separate words become blanks; all other bytes stay.
_BLANK = bytes(32 if not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else b for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_AUTOMATA: dict[str, tuple] = {}


def words_of(text: str | None) -> list[bytes]:
    """The normalised words; ``bytes.lower`` changes A-Z only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANK).split()


def build(items: list[tuple[str | None, str | None]]) -> tuple:
    """(codes of known words, automaton or None, items, their word codes)."""
    import ahocorasick

    codes: dict[bytes, int] = {}
    keys: dict[tuple[int, ...], tuple[list[int], list[tuple[int, int]]]] = {}
    coded = []
    for i, (_, text) in enumerate(items):
        seq = tuple(codes.setdefault(w, len(codes) + 1) for w in words_of(text))
        coded.append(seq)
        if 0 < len(seq) < WINDOW:
            keys.setdefault(seq, ([], []))[0].append(i)
        else:
            for at in range(0, len(seq) - RUN + 1, RUN):
                keys.setdefault(seq[at : at + RUN], ([], []))[1].append((i, at))
    if not keys:
        return codes, None, items, coded
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, (whole, runs) in keys.items():
        automaton.add_word(key, (len(key), tuple(whole), tuple(runs)))
    automaton.make_automaton()
    return codes, automaton, items, coded


def scan(text: str | None, built: tuple) -> tuple[int, list[tuple[int, int]], list[str]]:
    """(words, hit word ranges merged in order, ids of the items found)."""
    codes, automaton, items, coded = built
    words = words_of(text)
    if automaton is None or not words:
        return len(words), [], []
    get = codes.get
    seq = tuple([get(w, 0) for w in words])
    if not any(seq):
        return len(words), [], []
    found: set[int] = set()
    ranges = []
    reached: dict[tuple[int, int], int] = {}  # (item, shift) -> where its last match ended
    for end, (length, whole, runs) in automaton.iter(seq):
        start = end - length + 1
        if whole:
            ranges.append((start, end + 1))
            found.update(whole)
        for i, at in runs:
            if start < reached.get((i, start - at), 0):
                continue
            item = coded[i]
            back = 0
            while back < min(start, at) and seq[start - back - 1] == item[at - back - 1]:
                back += 1
            ahead = RUN
            while start + ahead < len(seq) and at + ahead < len(item) and seq[start + ahead] == item[at + ahead]:
                ahead += 1
            reached[i, start - at] = start + ahead
            if back + ahead >= WINDOW:
                ranges.append((start - back, start + ahead))
                found.add(i)
    ranges.sort()
    merged: list[tuple[int, int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return len(words), merged, sorted({str(items[i][0]) for i in found if items[i][0] is not None})


def _automaton(digest: str, items: list) -> tuple:
    if digest not in _AUTOMATA:
        _AUTOMATA[digest] = build(items)
    return _AUTOMATA[digest]


RESULT = "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,from:array<bigint>,to:array<bigint>,items:array<string>>"


def _scanner(items: list[tuple[str | None, str | None]]):
    digest = hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).hexdigest()

    @F.arrow_udf(RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        built = _automaton(digest, items)
        rows = []
        for text in texts.to_pylist():
            n, ranges, ids = scan(text, built)
            spots = [m.span() for m in _WORD.finditer(text)] if ranges else []
            rows.append({
                "n_words": n, "starts": [a for a, _ in ranges], "ends": [b for _, b in ranges],
                "from": [spots[a][0] for a, _ in ranges], "to": [spots[b - 1][1] for _, b in ranges], "items": ids,
            })
        many = pa.list_(pa.int64())
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("starts", many), ("ends", many), ("from", many), ("to", many), ("items", pa.list_(pa.string()))]))

    return scanned


def benchmark_groups(benchmark: DataFrame, group_chars: int = GROUP_CHARS):
    """Lists of (item_id, text), each of bounded size, read one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    groups = max(1, -(-int(total) * 2 // group_chars)) if total > group_chars else 1
    for g in range(groups):
        part = items if groups == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        yield sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or "", r[1]))


def _covered(ranges: Column) -> Column:
    """Words in a union of ranges given as sorted (start, end) structs."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(ranges, zero, lambda acc, r: F.struct(
        (acc["sum"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(r["start"], acc["end"]))).alias("sum"),
        F.greatest(acc["end"], r["end"]).alias("end")), lambda acc: acc["sum"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", share: int = 20, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``docs`` plus a struct ``contamination`` (the first free ``contamination_N`` if
    ``docs`` has one): n_words, n_hit, items, spans (character offsets of hit
    runs in the original text), contaminated."""
    small_batches(docs.sparkSession)
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    out, names = held, []
    for g, items in enumerate(benchmark_groups(benchmark, group_chars)):
        names.append(f"_scan{g}")
        out = out.withColumn(names[-1], _scanner(items)(F.col("_text")))
    scans = [F.col(n) for n in names]
    if len(scans) == 1:
        hit = F.aggregate(F.zip_with(scans[0]["starts"], scans[0]["ends"], lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
        ids = scans[0]["items"]
    else:
        ranges = F.array_sort(F.flatten(F.array(*[F.zip_with(s["starts"], s["ends"], lambda a, b: F.struct(a.alias("start"), b.alias("end"))) for s in scans])))
        hit = _covered(ranges)
        ids = F.array_sort(F.array_distinct(F.flatten(F.array(*[s["items"] for s in scans]))))
    spans = F.array_sort(F.flatten(F.array(*[F.zip_with(s["from"], s["to"], lambda a, b: F.struct(a.alias("start"), b.alias("end"))) for s in scans])))
    n = scans[0]["n_words"]
    return out.select("_row.*", F.struct(
        n.alias("n_words"), hit.alias("n_hit"), ids.alias("items"), spans.alias("spans"),
        ((hit > 0) & (hit * share >= n)).alias("contaminated")).alias(free_name(docs, "contamination")))


def decontamination_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns, one row a document."""
    out = decontaminate(docs.select("doc_id", "text"), benchmark)
    c = F.col("contamination")
    return out.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), c["contaminated"].alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever their names."""
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "text")
    return decontaminate(held, benchmark).filter(~F.col("contamination.contaminated")).select("row.*")
