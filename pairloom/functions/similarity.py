"""String similarities: built-ins where Spark has them, Arrow functions where not."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letter pairs that count as nearly equal, for lookups (price
#: 0.35) and for the reverse mapping (price 0.3).
LOOKUP_LETTERS = (("a", "à"), ("a", "á"), ("e", "é"), ("e", "è"), ("e", "ë"), ("i", "ï"), ("o", "ó"), ("u", "ú"), ("n", "ñ"), ("n", "ŋ"), ("c", "ç"))
REVERSE_LETTERS = (("a", "à"), ("a", "á"), ("a", "â"), ("a", "ä"), ("e", "é"), ("e", "è"), ("e", "ê"), ("e", "ë"), ("o", "ó"), ("n", "ñ"), ("n", "ŋ"))
LOOKUP_PRICE, REVERSE_PRICE = 0.35, 0.3


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def edit_distance(a: list, b: list, near: frozenset = frozenset(), price: float = 1.0) -> float:
    """Levenshtein over any items; substitutions in ``near`` cost ``price``."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[len(a) - 1 - last] == b[len(b) - 1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            swap = 0.0 if x == y else price if (x, y) in near else 1.0
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + swap)
    return row[-1]


def near_pairs(letters: tuple[tuple[str, str], ...]) -> frozenset:
    return frozenset(letters) | frozenset((b, a) for a, b in letters)


def weighted_distance(a: Column, b: Column, price: float = LOOKUP_PRICE, letters: tuple[tuple[str, str], ...] = LOOKUP_LETTERS) -> Column:
    """Edit distance with cheap substitutions between near letters."""
    near = near_pairs(letters)

    @F.arrow_udf("double")
    def distance(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else edit_distance(list(x), list(y), near, price) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())

    return distance(a, b)


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein over token arrays."""

    @F.arrow_udf("long")
    def distance(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else int(edit_distance(x, y)) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.int64())

    return distance(a, b)


def opcodes(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    return [x for x in SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes() if x[0] != "equal"]


EDIT = "array<struct<op:string,a_start:int,a_end:int,b_start:int,b_end:int,old:string,new:string>>"


def edits(a: Column, b: Column) -> Column:
    """Edit script between two token arrays (or strings split to characters)."""
    kind = pa.list_(pa.struct([("op", pa.string()), ("a_start", pa.int32()), ("a_end", pa.int32()), ("b_start", pa.int32()), ("b_end", pa.int32()), ("old", pa.string()), ("new", pa.string())]))

    @F.arrow_udf(EDIT)
    def script(left: pa.Array, right: pa.Array) -> pa.Array:
        rows = []
        for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
            x, y = x or [], y or []
            glue = "" if isinstance(x, str) or isinstance(y, str) else " "
            rows.append([
                {"op": op, "a_start": i, "a_end": j, "b_start": k, "b_end": m, "old": glue.join(x[i:j]), "new": glue.join(y[k:m])}
                for op, i, j, k, m in opcodes(list(x), list(y))])
        return pa.array(rows, kind)

    return script(a, b)


STEP = "array<struct<op:string,source:string,target:string>>"


def _columns(vp: int, vn: int, items: list, places: dict, full: int) -> Iterator[tuple[int, int, int]]:
    """The columns of the distance table after the one given, a bit a row: where the diagonal
    step is free, and where the step down costs +1 and -1 (Hyyrö's form of Myers' recurrence)."""
    for x in items:
        same = places.get(x, 0) & full
        free = ((((same & vp) + vp) ^ vp) | same | vn) & full
        right = (vn | (full ^ (free | vp))) << 1 | 1
        vp, vn = ((free & vp) << 1 | (full ^ ((free | right) & full))) & full, right & free
        yield free, vp, vn


#: Bits of a distance table that are held at once.
TABLE_BITS = 1 << 23


def operations(a: list, b: list) -> str:
    """One minimal edit path, a letter a step (keep, substitute, delete, insert); ties: substitute, then delete, then insert.

    A column of the distance table is two whole numbers, a bit a row.  Of a large
    table only every ``sqrt(m)``-th column is kept; those between two kept ones are
    made again, down to the row where the path stands, when the path gets there.
    """
    same = 0  # equal ends are always kept
    while same < min(len(a), len(b)) and a[len(a) - 1 - same] == b[len(b) - 1 - same]:
        same += 1
    i, j = len(a) - same, len(b) - same
    rows: dict = {}
    for k, x in enumerate(a[:i]):
        rows.setdefault(x, []).append(k)
    places = {}
    for x in rows.keys() & set(b[:j]):
        mask = bytearray(i // 8 + 1)
        for k in rows[x]:
            mask[k >> 3] |= 1 << (k & 7)
        places[x] = int.from_bytes(mask, "little")
    full = (1 << i) - 1
    step = max(j, 1) if i * j <= TABLE_BITS else isqrt(j) + 1
    kept = [(full, 0)]
    for k, (_, vp, vn) in enumerate(_columns(full, 0, b[: max(j - 1, 0) // step * step], places, full), 1):
        if k % step == 0:
            kept.append((vp, vn))
    out = ["k" * same]
    while i and j:
        base = (j - 1) // step * step
        low = (1 << i) - 1
        vp, vn = kept[base // step]
        block = [(free, down) for free, down, _ in _columns(vp & low, vn & low, b[base:j], places, low)]
        while i and j > base:
            if a[i - 1] == b[j - 1]:
                out.append("k")
                i, j = i - 1, j - 1
                continue
            free, down = block[j - base - 1]
            if not free >> (i - 1) & 1:
                out.append("s")
                i, j = i - 1, j - 1
            elif down >> (i - 1) & 1:
                out.append("d")
                i -= 1
            else:
                out.append("i")
                j -= 1
    out.append("d" * i or "i" * j)
    return "".join(reversed(out))


_NAMES = {"k": "keep", "s": "substitute", "d": "delete", "i": "insert"}


def backtrace(a: list, b: list) -> list[tuple[str, str | None, str | None]]:
    """The steps of ``operations`` with their items."""
    left, right = iter(a), iter(b)
    return [(_NAMES[op], None if op == "i" else next(left), None if op == "d" else next(right)) for op in operations(a, b)]


def edit_counts(a: Column, b: Column, separator: str) -> Column:
    """struct<keep, substitute, delete, insert>: how many of each the edit path has between the parts of two texts."""
    kind = pa.struct([(n, pa.int64()) for n in _NAMES.values()])
    cut = re.compile(separator)

    @F.arrow_udf("struct<keep:long,substitute:long,delete:long,insert:long>")
    def counts(left: pa.Array, right: pa.Array) -> pa.Array:
        paths = (operations(*(cut.split(v.as_py() or "") for v in pair)) for pair in zip(left, right, strict=True))
        return pa.array([{name: path.count(letter) for letter, name in _NAMES.items()} for path in paths], kind)

    return counts(a, b)


def alignment(a: Column, b: Column) -> Column:
    """Aligned steps between two token arrays."""
    kind = pa.list_(pa.struct([("op", pa.string()), ("source", pa.string()), ("target", pa.string())]))

    @F.arrow_udf(STEP)
    def steps(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([[{"op": o, "source": s, "target": t} for o, s, t in backtrace(x or [], y or [])] for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], kind)

    return steps(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long arrays of numbers, in the JVM."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def position_score(i: Column, n: Column, j: Column, m: Column, sigma: float = 0.35) -> Column:
    """Gaussian in the distance of relative positions."""
    gap = i / F.greatest(n - 1, F.lit(1)) - j / F.greatest(m - 1, F.lit(1))
    return F.exp(-(gap * gap) / (2 * sigma * sigma))
