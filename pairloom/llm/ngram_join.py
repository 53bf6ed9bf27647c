r"""Jaccard self-join of word n-gram sets by signature trees.

A-Z are lower-cased, words are ``[^\x20\x09-\x0D]+``, and a document's set is
its distinct n-word shingles (a shorter text is one shingle; no words: empty,
linked with nothing).  Two documents link when ``100 * intersection >= percent
* union``; the result is the connected component of every document.

1. Documents with equal sets form a class; copies take part once.
2. Routing: a class goes to the shingles of its prefix, the part that any link
   must share under one order of all shingles.  The order puts the corpus's
   frequent shingles last, so shared lines and passages bring nobody together.
   A shingle's classes fall into runs of sizes that can link; a shingle whose
   counted postings are many (``HOT``) is cut by bands of sizes instead, without
   a window.  Of the groups with the same classes one is kept.
3. Inside each routed group stands a signature tree: nodes hold the
   OR-combined shingle bitmaps and the size range of their members.  A dual
   traversal prunes node pairs by the largest possible overlap, by sizes, and
   where both sides are connected already.  Pairs that stay open connect into
   candidate clusters.
4. Each class's whole set travels once, to its cluster, where a second tree
   verifies the open pairs of its leaves exactly.
5. A group of more than ``TILE`` classes is dealt to tiles.  Up to ``DIRECT``
   tiles, each pair of tiles is a task of its own.  Beyond, tiles hold size bands,
   and the work is staged: each tile links its own members; the members that
   answered for others are linked among themselves; at last the pairs of tiles
   are listed, as one narrow row a tile, and only pairs whose size bands can
   link and whose members are not all connected already move their rows.  So a
   large group of near copies costs its size, and no group has to fit into one
   task.  A group answers with at most two edges a member, never with all pairs,
   and components come from alternating star contractions.

Shingles and sets are 64-bit keys.  For equal keys of different sets among
n classes the odds are n*n / 2**65.

Defined results: null text is empty; repeated rows get the same answer; a row
without an id gets the smallest id of its component, and null if no row of it
has one; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, lookup, materialize, salted_left_join, scratch, size_checked, small_batches

#: Most classes of a group that one task holds; least bits of a bitmap; leaf size.
TILE, BITS, LEAF = 512, 512, 8
#: Tiles of a group up to which all their pairs are compared at once.
DIRECT = 16
#: Postings of a shingle beyond which its classes are grouped without a window.
HOT = 20_000
#: Frequent shingles that the order puts last: at most so many, the most frequent.
HEAVY = 500_000
#: A shingle is reported by a task if at least so many of its classes have it, and one in SHARE.
LOCAL, SHARE = 3, 4000
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(18, (n - 1).bit_length())
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.ones(size, np.uint64)
            done = 1
            while done < size:
                table[done : 2 * done] = table[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            _POWERS.append(table)
    return _POWERS[0], _POWERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int, chunk: int = 1 << 18) -> Iterator[np.ndarray]:
    """Sorted distinct shingle keys of each text."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))
        size += len(held[-1]) + 1
        if size >= chunk:
            yield from _sets(held, n)
            held, size = [], 0
    yield from _sets(held, n)


def _sets(docs: list[bytes], n: int) -> Iterator[np.ndarray]:
    """A shingle is a stretch of bytes; its key comes from running sums of byte * base**position."""
    if not docs:
        return
    raw = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
    powers, inverse = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
        ends = np.flatnonzero(raw == 32)
        at = word = 0
        for doc in docs:
            stop = at + len(doc)
            if not doc:
                word += 1  # the blank that follows an empty text ends no word
                at = stop + 1
                yield np.zeros(0, np.uint64)
                continue
            count = doc.count(b" ") + 1
            mine = ends[word : word + count]
            starts = np.empty(count, np.int64)
            starts[0] = at
            starts[1:] = mine[:-1] + 1
            if count < n:
                starts, mine = starts[:1], mine[-1:]
            else:
                starts, mine = starts[: count - n + 1], mine[n - 1 :]
            keys = np.sort(_mix((sums[mine] - sums[starts]) * inverse[starts] + np.uint64(min(count, n))))
            fresh = np.ones(len(keys), bool)
            fresh[1:] = keys[1:] != keys[:-1]
            yield keys[fresh]
            word += count
            at = stop + 1


def width(n: int) -> int:
    """Bits of a bitmap: a power of two of at least the set's size."""
    return max(BITS, 1 << (n - 1).bit_length())


def bitmap(shingles: np.ndarray) -> np.ndarray:
    bits = width(len(shingles))
    row = np.zeros(bits, np.uint8)
    row[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(row, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A wider bitmap as the narrower one of the same set."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def class_key(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=7)).astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(1).to_pylist()


NAMES = ["id", "n_shingles", "cls", "bits", "token", "docs"]


def _describe(n: int):
    """Arrow pass: (id, n_shingles, cls) of every document, and the shingles frequent in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        met: set[int] = set()
        docs = held = 0

        def frequent() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = counts >= max(LOCAL, docs // SHARE)
            m = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(keys[often].astype(np.int64)), pa.array(counts[often].astype(np.int64))],
                names=NAMES)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            sizes, classes, bits = [], [], []
            for s in shingle_sets(_texts(batch), n):
                sizes.append(len(s))
                classes.append(class_key(s) if len(s) else None)
                bits.append(bitmap(s).tobytes() if len(s) else None)
                if classes[-1] in met:
                    continue
                met.add(classes[-1])
                seen.append(s)
                docs += 1
                held += len(s)
                if held >= 3 << 19:
                    yield frequent()
                    seen.clear()
                    met.clear()
                    docs = held = 0
            m = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())],
                names=NAMES)
        if seen:
            yield frequent()

    return run


def _postings(n: int, percent: int, heavy: np.ndarray):
    """Arrow pass: (token, cls, n, heavy) for the prefix of every class that the task meets.

    At its end the task adds (token, null, times, null) for the rare shingles that
    it met twice or more, so that frequent ones are known without counting all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        seen: list[np.ndarray] = []
        for batch in batches:
            tokens, owners, often, sizes = [], [], [], []
            for s in shingle_sets(_texts(batch), n):
                if not len(s):
                    continue
                key = class_key(s)
                if key in met:
                    continue
                met.add(key)
                at = np.searchsorted(heavy, s)
                flag = heavy[np.minimum(at, len(heavy) - 1)] == s if len(heavy) else np.zeros(len(s), bool)
                p = prefix_length(len(s), percent)
                order = np.concatenate([np.flatnonzero(~flag)[:p], np.flatnonzero(flag)[:p]])[:p]
                tokens.append(s[order])
                often.append(flag[order])
                owners.append(np.full(len(order), key, np.int64))
                sizes.append(np.full(len(order), len(s), np.int32))
            if tokens:
                every, flags = np.concatenate(tokens), np.concatenate(often)
                seen.append(every[~flags])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every.astype(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes)), pa.array(flags)],
                    names=["token", "cls", "n", "heavy"])
        if seen:
            keys, times = np.unique(np.concatenate(seen), return_counts=True)
            keys, times = keys[times > 1], times[times > 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64)), pa.nulls(len(keys), pa.int64()), pa.array(times.astype(np.int32)), pa.nulls(len(keys), pa.bool_())], names=["token", "cls", "n", "heavy"])

    return run


def _whole_sets(n: int):
    """Arrow pass: (cls, data), each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            fresh = {}
            for s in shingle_sets(_texts(batch), n):
                key = class_key(s)
                if key not in met:
                    met.add(key)
                    fresh[key] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.int64()), pa.array(list(fresh.values()), pa.binary())], names=["cls", "data"])

    return run


class SignatureTree:
    """Members sorted by size; a node is a range of them with an OR bitmap and a size range.

    With ``sets`` the leaves verify pairs exactly; without, every pair that the
    bitmaps leave open counts as linked, which gives candidate clusters.
    """

    def __init__(self, n: list[int], bits: np.ndarray, percent: int, sets: list[np.ndarray] | None = None):
        self.percent = percent
        self.order = sorted(range(len(n)), key=lambda i: (n[i], bits[i].tobytes()))
        self.sets = None if sets is None else [sets[i] for i in self.order]
        self.n = np.array([n[i] for i in self.order], np.int64)
        self.bits = bits[self.order]
        self.slack = self.n - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.nodes: dict[tuple[int, int], tuple] = {}
        self.root = list(range(len(n)))

    def node(self, lo: int, hi: int) -> tuple:
        if (lo, hi) not in self.nodes:
            self.nodes[lo, hi] = (
                np.bitwise_or.reduce(self.bits[lo:hi]), int(self.n[lo]), int(self.n[hi - 1]), int(self.slack[lo:hi].max()))
        return self.nodes[lo, hi]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def joined(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        first = self.find(a[0])
        return all(self.find(i) == first for r in (a, b) for i in range(*r))

    def hopeless(self, a: tuple, b: tuple) -> bool:
        """No pair of members can link: sizes too far apart, or too little possible overlap."""
        if a[2] * 100 < self.percent * b[1] or b[2] * 100 < self.percent * a[1]:
            return True
        both = int(np.bitwise_count(a[0] & b[0]).sum())
        most = min(a[2], b[2], a[3] + both, b[3] + both)
        return most * (100 + self.percent) < self.percent * (a[1] + b[1])

    def links(self, *side: list[int]) -> list[int]:
        """Roots of the members, in the callers' order, after the dual traversal.

        Only pairs that differ in every given ``side`` are compared.
        """
        sides = [np.array([x[i] for i in self.order]) for x in side]
        whole = (0, len(self.n))
        stack = [(whole, whole)] if len(self.n) > 1 else []
        while stack:
            a, b = stack.pop()
            if self.hopeless(self.node(*a), self.node(*b)) or self.joined(a, b):
                continue
            if a[1] - a[0] <= LEAF and b[1] - b[0] <= LEAF:
                self.leaves(a, b, sides)
                continue
            if a == b:
                mid = (a[0] + a[1]) // 2
                left, right = (a[0], mid), (mid, a[1])
                stack += [(left, right), (right, right), (left, left)]
            else:
                wide, other = (a, b) if a[1] - a[0] >= b[1] - b[0] else (b, a)
                mid = (wide[0] + wide[1]) // 2
                stack += [((wide[0], mid), other), ((mid, wide[1]), other)]
        out = [0] * len(self.n)
        for at, i in enumerate(self.order):
            out[i] = self.order[self.find(at)]
        return out

    def leaves(self, a: tuple[int, int], b: tuple[int, int], sides: list[np.ndarray]) -> None:
        both = np.bitwise_count(self.bits[a[0] : a[1], None] & self.bits[None, b[0] : b[1]]).sum(2).astype(np.int64)
        na, nb = self.n[a[0] : a[1], None], self.n[None, b[0] : b[1]]
        most = np.minimum(self.slack[a[0] : a[1], None] + both, self.slack[None, b[0] : b[1]] + both)
        open_ = most * (100 + self.percent) >= self.percent * (na + nb)
        for x in sides:
            open_ &= x[a[0] : a[1], None] != x[None, b[0] : b[1]]
        for i, j in zip(*np.nonzero(open_), strict=True):
            i, j = int(i) + a[0], int(j) + b[0]
            if i == j:
                continue
            x, y = self.find(i), self.find(j)
            if x == y:
                continue
            if self.sets is None or linked(self.sets[i], self.sets[j], self.percent):
                self.root[max(x, y)] = min(x, y)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def group_edges(keys: list[int], n: list[int], bits: list[np.ndarray], percent: int, side: list[int] | None = None, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Edges that together connect what the group's pairs connect, at most two a member.

    Members with bitmaps of one width share a tree.  Sizes of linked sets
    differ by less than half where ``percent`` is above 50, so only
    neighbouring widths are compared too, the wider folded to the narrower.
    """
    by_width: dict[int, list[int]] = {}
    for i, b in enumerate(bits):
        by_width.setdefault(len(b), []).append(i)
    out = []
    widths = sorted(by_width)
    for k, w in enumerate(widths):
        reach = [v for v in widths[k + 1 :] if v == 2 * w or percent <= 50]
        for v in [w, *reach]:
            mine = by_width[w] + (by_width[v] if v != w else [])
            if len(mine) < 2:
                continue
            table = np.stack([bits[i] if len(bits[i]) == w else folded(bits[i], w) for i in mine])
            sides = [[len(bits[i]) for i in mine]] if v != w else []
            if side is not None:
                sides.append([side[i] for i in mine])
            tree = SignatureTree([n[i] for i in mine], table, percent, None if sets is None else [sets[i] for i in mine])
            out += [(keys[mine[i]], keys[mine[r]]) for i, r in enumerate(tree.links(*sides)) if r != i]
    return out


def _group_links(percent: int, exact: bool):
    """Arrow pass over rows sorted by (grp, tile_a, tile_b): the edges of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                keys, tiles, n, bits, sets = zip(*held, strict=True)
                out.extend(group_edges(list(keys), list(n), list(bits), percent, None if now[1] == now[2] else list(tiles), list(sets) if exact else None))

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
            out.clear()
            return batch

        for batch in batches:
            names = ("grp", "tile_a", "tile_b", "cls", "tile") + (() if exact else ("n_shingles",))
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            raw = batch.column(batch.schema.get_field_index("data"))
            for at, (group, ta, tb, key, tile, *n) in enumerate(zip(*cols, strict=True)):
                if (group, ta, tb) != now:
                    close()
                    now, held = (group, ta, tb), []
                if held and held[-1][0] == key:
                    continue  # a copy that another task sent
                data = np.frombuffer(raw[at].as_py(), np.uint64)
                if exact:
                    held.append((key, tile, len(data), bitmap(data), data))
                else:
                    held.append((key, tile, n[0], data, None))
            if out:
                yield emit()
        close()
        if out:
            yield emit()

    return run


def _band(n: Column, percent: int) -> Column:
    """Size bands: sets of sizes in bands that are not neighbours cannot link."""
    return F.floor(F.log(n.cast("double")) / math.log(100.0 / percent * 1.0001)).cast("long")


def _linked_groups(placed: DataFrame, percent: int, exact: bool) -> DataFrame:
    groups = placed.repartition("grp", "tile_a", "tile_b").sortWithinPartitions("grp", "tile_a", "tile_b", "cls")
    return materialize(groups.mapInArrow(_group_links(percent, exact), "a long, b long").distinct())


def _edges(members: DataFrame, attach: Callable[[DataFrame], DataFrame], percent: int, exact: bool) -> DataFrame:
    """Edges that connect what the groups' pairs connect.

    ``members``: grp, cls, n, members (of the group).  ``attach`` adds
    ``n_shingles`` and ``data`` to rows with a cls.
    """
    tiles = F.ceil(F.col("members") / F.lit(TILE)).cast("long")
    dealt = members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")))
    small = dealt.filter(F.col("tiles") <= DIRECT).withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
    small = small.select("grp", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), "cls", "tile")
    edges = _linked_groups(attach(small), percent, exact)
    if not members.filter(F.col("members") > TILE * DIRECT).limit(1).count():
        return edges
    return materialize(edges.unionByName(_staged_edges(dealt.filter(F.col("tiles") > DIRECT), attach, percent, exact)).distinct())


def _staged_edges(dealt: DataFrame, attach: Callable[[DataFrame], DataFrame], percent: int, exact: bool) -> DataFrame:
    """``_edges`` of the largest groups."""
    big = materialize(dealt.select("grp", "cls", (_band(F.col("n"), percent) * (1 << 32) + F.col("tile")).alias("tile"), "members"))
    own = [F.col("tile").alias("tile_a"), F.col("tile").alias("tile_b")]
    edges = _linked_groups(attach(big.select("grp", *own, "cls", "tile")), percent, exact)

    def pairs_of(table: DataFrame) -> DataFrame:
        """(at: grp and tile, p: its pairs of tiles that may still link), from one row a tile with its least and largest root."""
        known = table.groupBy("grp", "tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).withColumn("band", F.shiftright("tile", 32))
        left = known.select("grp", *[F.col(c).alias(f"{c}_a") for c in ("tile", "lo", "hi", "band")])
        right = known.select("grp", *[F.col(c).alias(f"{c}_b") for c in ("tile", "lo", "hi", "band")])
        near = F.abs(F.col("band_a") - F.col("band_b")) <= 1
        one = (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b"))
        found = left.join(right, "grp").filter((F.col("tile_a") < F.col("tile_b")) & near & ~one).select("grp", F.struct("tile_a", "tile_b").alias("p"))
        each = found.select(F.explode(F.array(F.struct("grp", F.col("p.tile_a").alias("tile")), F.struct("grp", F.col("p.tile_b").alias("tile")))).alias("at"), "p")
        return each.groupBy("at").agg(F.collect_list("p").alias("p"))

    def moved(table: DataFrame, pairs: DataFrame) -> DataFrame:
        rows = salted_left_join(table.select("cls", F.struct("grp", "tile").alias("at")), pairs, "at", F.col("cls"))
        return rows.select("cls", "at.*", F.explode("p").alias("p")).select("grp", "p.*", "cls", "tile")

    # a member without an edge to another one answers for those that point at it
    pointed = edges.select(F.col("a").alias("cls"), F.lit(True).alias("_away")).distinct()
    heads = salted_left_join(big, pointed, "cls", F.col("grp")).filter("_away is null").drop("_away")
    few = heads.groupBy("grp").agg(F.count(F.lit(1)).alias("heads"), F.max("members").alias("_all")).filter("heads > 1 and heads * 4 <= _all").select("grp", "heads")
    heads = salted_left_join(heads, few, "grp", F.col("cls")).filter("heads is not null")
    heads = materialize(heads.select("grp", "cls", F.when(F.col("heads") <= TILE, F.lit(0).cast("long")).otherwise(F.col("tile")).alias("tile"), F.col("cls").alias("root")))
    if heads.limit(1).count():
        placed = heads.select("grp", *own, "cls", "tile").unionByName(moved(heads, pairs_of(heads)))
        edges = materialize(edges.unionByName(_linked_groups(attach(placed), percent, exact)).distinct())
    # what is left: pairs of tiles that are not connected as a whole
    roots = components(edges).select(F.col("node").alias("cls"), "root")
    table = materialize(salted_left_join(big, roots, "cls", F.col("grp")).withColumn("root", F.coalesce("root", "cls")))
    left = materialize(pairs_of(table))
    if left.limit(1).count():
        edges = edges.unionByName(_linked_groups(attach(moved(table, left)), percent, exact))
    return edges


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating large and small stars.

    Minima are pre-aggregated and joined back with salts, so a node with very
    many neighbours meets many tasks.  Every round is written to the shared
    folder, which cuts the lineage.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # arcs: node -> neighbour; large stars look both ways, small stars to smaller neighbours only
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        joined = salted_left_join(both, low, "a", F.col("b"), salts=8)
        if large:
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, old = state, now
        now = materialize(star(star(old, True), False))
        discard(old)
    raise RuntimeError("components did not settle")


def frequent_shingles(described: DataFrame) -> np.ndarray:
    """The most frequent shingles, ``HEAVY`` at most: all above the count that so many reach.

    A histogram of the counts finds that count, so nothing is sorted.
    """
    totals = materialize(described.filter("token is not null").groupBy("token").agg(F.sum("docs").alias("docs")))
    room, least = HEAVY, None
    for r in totals.groupBy("docs").count().orderBy(F.desc("docs")).limit(100_000).toLocalIterator():
        room -= r["count"]
        if room < 0:
            break
        least = r["docs"]
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(totals.filter(F.col("docs") >= least).select("token").toArrow().column(0).to_numpy().astype(np.uint64))


def link_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    described = materialize(plain.mapInArrow(_describe(words), "id long, n_shingles long, cls long, bits binary, token long, docs long"))
    rows = described.filter("token is null").select("id", "n_shingles", "cls")
    heavy = frequent_shingles(described)
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("docs"))
    signatures = described.filter("cls is not null").select("cls", "n_shingles", F.col("bits").alias("data")).dropDuplicates(["cls"])

    postings = materialize(plain.mapInArrow(_postings(words, percent, heavy), "token long, cls long, n int, heavy boolean"))
    hot = materialize(postings.filter("cls is null").groupBy("token").agg(F.sum("n").alias("times")).filter(F.col("times") > HOT).select("token", F.lit(True).alias("hot")))
    postings, written = postings.filter("cls is not null"), postings
    if hot.limit(1).count():
        postings = lookup(postings, hot, "token", F.col("cls")).withColumn("heavy", F.col("heavy") | F.coalesce("hot", F.lit(False))).drop("hot")
    # rare shingles: their groups are small, so one exchange by shingle serves all that
    # follows; a group falls into runs of sizes that can link
    rare = postings.filter("not heavy").select("token", "cls", "n").repartition("token").groupBy("token", "cls").agg(F.max("n").alias("n"))
    gap = F.lag("n").over(Window.partitionBy("token").orderBy("n", "cls")) * 100 < percent * F.col("n")
    rare = rare.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int"))
    rare = rare.withColumn("run", F.sum("_gap").over(Window.partitionBy("token").orderBy("n", "cls").rowsBetween(Window.unboundedPreceding, 0)))
    near = Window.partitionBy("token", "run")
    sums = [F.count(F.lit(1)), F.sum(F.xxhash64("cls", F.lit(1)) % (1 << 40)), F.sum(F.xxhash64("cls", F.lit(2)) % (1 << 40))]
    names = ["members", "sum_a", "sum_b"]
    rare = rare.select(F.xxhash64("token", "run").alias("grp"), "cls", "n", *[c.over(near).alias(n) for c, n in zip(sums, names, strict=True)]).filter("members > 1")
    # frequent shingles: a class goes to its size band and the next one; groups are pre-aggregated, and joined back with salts
    band = _band(F.col("n"), percent)
    full = postings.filter("heavy").select("token", "cls", "n", F.explode(F.array(band, band + 1)).alias("band"))
    full = full.select(F.xxhash64("token", "band", F.lit("band")).alias("grp"), "cls", "n").distinct()
    totals = full.groupBy("grp").agg(*[c.alias(n) for c, n in zip(sums, names, strict=True)])
    full = salted_left_join(full, totals, "grp", F.col("cls")).filter("members > 1").select("grp", "cls", "n", *names)
    members = materialize(rare.unionByName(full))
    discard(written)
    # of the groups that bring the same classes together, one is enough
    kept = members.groupBy(*names).agg(F.min("grp").alias("grp")).select("grp", F.lit(True).alias("kept"))
    groups = salted_left_join(members, kept, "grp", F.col("cls")).filter("kept").select("grp", "cls", "n", "members")

    # candidate clusters from bitmaps alone; each set then travels once, to its cluster
    open_pairs = _edges(groups, lambda placed: placed.join(signatures, "cls"), percent, exact=False)
    found = components(open_pairs)
    clusters = found.select(F.col("node").alias("cls"), F.col("root").alias("grp")).unionByName(found.select(F.col("root").alias("cls"), F.col("root").alias("grp")).distinct())
    counts = clusters.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    clusters = salted_left_join(clusters, counts, "grp", F.col("cls"))
    clusters = materialize(clusters.join(signatures.select("cls", F.col("n_shingles").cast("int").alias("n")), "cls").select("grp", "cls", "n", "members"))
    wanted = materialize(clusters.select("cls").join(classes, "cls").select(F.col("rep").alias("id")))
    some, _ = size_checked(wanted.filter("id is not null"), 500_000)
    source = plain.join(some, "id", "left_semi")
    if wanted.filter("id is null").limit(1).count():
        source = source.unionByName(plain.filter("id is null"))
    sets = source.mapInArrow(_whole_sets(words), "cls long, data binary")
    if clusters.filter(F.col("members") > TILE).limit(1).count():
        sets = materialize(sets)
    links = _edges(clusters, lambda placed: placed.join(sets, "cls"), percent, exact=True)

    roots = components(links)
    mine = roots.select(F.col("node").alias("cls"), "root").unionByName(roots.select(F.col("root").alias("cls"), "root").distinct()).join(classes, "cls")
    least = mine.groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = salted_left_join(mine.select("cls", "root"), least, "root", F.col("cls")).select("cls", "component_id")
    linked = classes.join(moved, "cls", "left").select("cls", "docs", F.coalesce("component_id", "rep").alias("component_id"), F.col("component_id").isNotNull().alias("_moved"))
    linked = linked.filter("docs > 1 or _moved").select("cls", "component_id")
    out = salted_left_join(rows, linked, "cls", F.coalesce(F.col("id"), F.lit(0)))
    return out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def link_rows(docs: DataFrame) -> DataFrame:
    """The contract's columns: 3-word shingles, 90 percent."""
    return link_documents(docs, 3, 90).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id.

    A document is its id and its text: rows that share an id but not the text are
    different documents, of which the one with the smaller key stays if they are
    linked, and rows equal in both are one.  Rows without an id stay.  The keys
    that go are broadcast only if counted as few.
    """
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    with scratch() as tables:
        linked = materialize(link_documents(keyed, words, percent, id_col=key).select("id", "component_id"))
        tables.pop()  # this one stays
    owned = linked.groupBy("id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("times"))
    owned = materialize(owned.join(keyed.filter("doc_id is not null").select(F.col(key).alias("id"), "doc_id").distinct(), "id"))
    first = owned.groupBy("component_id").agg(F.min(F.struct("doc_id", "id"))["id"].alias("stays"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    gone = salted_left_join(owned, first.select("component_id", "stays"), "component_id", F.col("id")).filter("id <> stays")
    few, _ = size_checked(materialize(gone.select(F.col("id").alias(key))))
    out = keyed.join(few, key, "left_anti")
    repeated = owned.filter("times > 1").select(F.col("id").alias(key))
    if repeated.limit(1).count():
        again, _ = size_checked(repeated)
        once = out.join(again, key, "left_anti")
        out = once.unionByName(out.join(again, key, "left_semi").dropDuplicates([key]))
    return out.select(*docs.columns)
