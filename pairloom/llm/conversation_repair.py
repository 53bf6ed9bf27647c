r"""Conversation structure repair: a min-plus matrix scan over the turns.

A legal conversation has role initials ``(s?(ua)+)?``, an automaton of four
states: nothing yet, after the system turn, after a user turn, after an
assistant turn.  A turn becomes a 4x4 matrix whose entry (i, j) is the
cheapest way, as a pair (cost, audit), from state i before the turn to state j
after it, insertions before the turn included (the insert closure).  Products
take the least pair, costs add up and audits are joined, so the product over
all turns, closed once more, holds the repair.  Two audits of equal cost for
the same turns are never prefixes of each other (they would differ by paid
insertions), so the order of pairs survives joining and the product is
associative.

* Rows are cut into chunks by range partitions of (conversation, turn), so a
  conversation of any length is spread over many tasks.  A chunk is reduced to
  one element: a matrix, counts, and the first and last turn.
* The elements of a conversation are multiplied as a tree, ``FAN`` neighbours a
  group, one shuffle of narrow rows a level.
* The repaired turns come from one sorted stream a conversation, its plan
  first; a row at a time is held, so memory is bounded.  Its digest is one
  SHA-256 over the whole conversation and therefore one task's work.

Faults, the first one counts: ``blank`` (no ``[^\x20\x09-\x0D]``),
``duplicate`` (role and text seen earlier in the conversation), ``truncated``
(the last such character is not one of ``.!?``).  Edits: Keep 0, Rerole to user
or assistant 3, Delete 4 (the only one for blank and duplicate rows), Insert an
empty user or assistant turn 3; a truncated row that stays adds 3.

Defined results: a null role or text is one space, a null ``conv_id`` is a
conversation of its own (one space in damage keys), null turns come first;
rows of one turn are ordered by role and MD5 of the text, so repeated rows are
neighbours; an empty role has no legal initial; a conversation without rows
has zeros, an empty audit and the digest of an empty string; an empty table
gives an empty table; extra columns of any name are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialize, small_batches

#: Elements multiplied in one group of a tree level.
FAN = 64
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: States of the automaton, and those where a conversation may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (NOTHING, ASSISTANT)
#: Initials ("x": any other) and faults of a row; a row's letter is their pair.
INITIALS, FAULTS = "suax", ("", "truncated", "duplicate", "blank")
LETTERS = "abcdefghijklmnop"

Entry = tuple[int, str] | None
Matrix = tuple[tuple[Entry, ...], ...]


def _next_state(state: int, initial: str) -> int | None:
    """The state after a turn with ``initial``, if it may follow ``state``."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def times(left: Matrix, right: Matrix) -> Matrix:
    """The min-plus product over (cost, audit) pairs."""
    columns = tuple(zip(*right))
    return tuple(
        tuple(min(((a[0] + b[0], a[1] + b[1]) for a, b in zip(row, column) if a is not None and b is not None), default=None) for column in columns)
        for row in left
    )


def _closure() -> Matrix:
    """The cheapest runs of insertions from each state to each other one."""
    single = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for state in range(4):
        for initial in "ua":
            after = _next_state(state, initial)
            if after is not None:
                single[state][after] = min(x for x in (single[state][after], (INSERT, "I")) if x is not None)
    once = tuple(map(tuple, single))
    return times(times(once, once), once)


CLOSURE = _closure()


@lru_cache(maxsize=64)
def _turn(letter: str) -> Matrix:
    """The matrix of one row, insertions before it included."""
    initial, fault = INITIALS[LETTERS.index(letter) // 4], FAULTS[LETTERS.index(letter) % 4]
    edits: list[list[Entry]] = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if fault in ("", "truncated"):
        extra = TRUNCATED if fault else 0
        for state in range(4):
            for cost, audit, role in ((KEEP, "K", initial), (REROLE, "R", "u"), (REROLE, "R", "a")):
                after = _next_state(state, role)
                if after is not None:
                    edits[state][after] = min(x for x in (edits[state][after], (cost + extra, audit)) if x is not None)
    return times(CLOSURE, tuple(map(tuple, edits)))


@lru_cache(maxsize=20_000)
def _short(letters: str) -> Matrix:
    return _turn(letters) if len(letters) == 1 else times(_short(letters[: len(letters) // 2]), _short(letters[len(letters) // 2 :]))


def product(letters: str) -> Matrix:
    """The product of a run of rows, as a balanced tree; runs of up to four rows are remembered."""
    if len(letters) <= 4:
        return _short(letters)
    half = (len(letters) // 2 + 3) // 4 * 4
    return times(product(letters[:half]), product(letters[half:]))


def best(matrix: Matrix | None) -> tuple[int, str]:
    """Cost and audit of the cheapest legal conversation."""
    if matrix is None:
        return 0, ""
    closed = times(matrix, CLOSURE)
    return min(closed[NOTHING][j] for j in FINAL if closed[NOTHING][j] is not None)


ELEMENT = (
    "costs array<bigint>, audits array<string>, n_blank bigint, n_duplicate bigint, n_truncated bigint, illegal bigint, "
    "first_initial string, last_initial string, first_turn bigint, last_turn bigint, turns bigint"
)


def _pack(matrix: Matrix | None) -> dict:
    flat = [x for row in matrix for x in row] if matrix is not None else []
    return {"costs": [None if x is None else x[0] for x in flat], "audits": [None if x is None else x[1] for x in flat]}


def _unpack(element: dict) -> Matrix | None:
    flat = [None if a is None else (int(c), a) for c, a in zip(element["costs"], element["audits"])]
    return tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4)) if flat else None


def _illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def _of_chunk(letters: str, first_turn, last_turn, turns: int) -> dict:
    """The element of a chunk's rows."""
    initials = "".join(INITIALS[LETTERS.index(x) // 4] for x in letters)
    counts = {f"n_{f}": sum(letters.count(x) for x in LETTERS[k::4]) for k, f in enumerate(FAULTS) if f}
    return {
        **_pack(product(letters) if letters else None), **counts, "illegal": sum(map(_illegal, initials, initials[1:])),
        "first_initial": initials[:1], "last_initial": initials[-1:], "first_turn": first_turn, "last_turn": last_turn, "turns": turns,
    }


def _joined(left: dict, right: dict) -> dict:
    """The element of two neighbouring runs; associative."""
    a, b = _unpack(left), _unpack(right)
    out = _pack(times(a, b) if a is not None and b is not None else a if b is None else b)
    for c in ("n_blank", "n_duplicate", "n_truncated", "illegal"):
        out[c] = left[c] + right[c]
    if left["last_initial"] and right["first_initial"]:
        out["illegal"] += _illegal(left["last_initial"], right["first_initial"])
    out["first_initial"] = left["first_initial"] or right["first_initial"]
    out["last_initial"] = right["last_initial"] or left["last_initial"]
    known = [x for x in (left, right) if x["last_turn"] is not None]
    out["first_turn"] = known[0]["first_turn"] if known else None
    out["last_turn"] = known[-1]["last_turn"] if known else None
    # the runs are neighbours in the order of turns: they can share one turn only
    out["turns"] = left["turns"] + right["turns"] - (len(known) == 2 and left["last_turn"] == right["first_turn"])
    return out


def _tree(elements: list[dict]) -> dict:
    while len(elements) > 1:
        elements = [_joined(*elements[i : i + 2]) if i + 1 < len(elements) else elements[i] for i in range(0, len(elements), 2)]
    return elements[0]


def _chunk_column() -> object:
    @F.pandas_udf(ELEMENT)
    def of_chunk(letters: pd.Series, first: pd.Series, last: pd.Series, turns: pd.Series) -> pd.DataFrame:
        number = lambda x: None if pd.isna(x) else int(x)
        return pd.DataFrame([_of_chunk(*x) for x in zip(letters, map(number, first), map(number, last), map(int, turns))])

    return of_chunk


def _tree_column() -> object:
    @F.pandas_udf(ELEMENT)
    def of_group(groups: pd.Series) -> pd.DataFrame:
        number = lambda x: None if pd.isna(x) else int(x)
        out = []
        for g in groups:
            rows = [dict(x["e"]) for x in g]
            for r in rows:
                r.update(first_turn=number(r["first_turn"]), last_turn=number(r["last_turn"]))
            out.append(_tree(rows))
        return pd.DataFrame(out)

    return of_group


def _best_column() -> object:
    @F.pandas_udf("cost bigint, audit string")
    def of_best(elements: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([best(_unpack(x)) for x in elements[["costs", "audits"]].to_dict("records")], columns=["cost", "audit"])

    return of_best


def as_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` as named here, with one space for null roles and texts, a key and the number of copies (1)."""
    return conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key"), F.lit(1).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage by CRC-32 of ``conv_id:turn``; a dropped row stays with no copies."""
    space = F.lit(" ")
    code = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))), F.lit(20))
    return rows.withColumn("_code", code).select(
        "conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        "key", F.when(F.col("_code") == 0, 0).when(F.col("_code") == 3, 2).otherwise(F.col("copies")).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.md5("text")).alias("digest")


def _letters(first: Column, copies: Column) -> Column:
    """A row's letter, then those of its copies."""
    at = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 4).when(F.col("initial") == "a", 8).otherwise(12)
    letter = lambda fault: F.substring(F.lit(LETTERS), at + F.lit(1 + FAULTS.index(fault)), F.lit(1))
    own = F.when(F.col("ended"), letter("")).otherwise(letter("truncated"))
    return F.when(copies == 0, "").when(F.col("blank"), F.repeat(letter("blank"), copies)).otherwise(
        F.concat(F.when(first, own).otherwise(letter("duplicate")), F.repeat(letter("duplicate"), copies - 1)))


def plans(rows: DataFrame) -> DataFrame:
    """One row a conversation: ``key, conv_id``, the faults found, ``cost`` and ``audit``.

    Texts stay where they are: what is shuffled is a digest and two flags a row.
    """
    small_batches(rows.sparkSession)
    shown = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    narrow = rows.select(
        "key", "conv_id", "turn", "role", _digest(), F.col("copies").cast("int").alias("copies"), F.substring("role", 1, 1).alias("initial"),
        (shown == "").alias("blank"), F.substring(shown, -1, 1).isin(".", "!", "?").alias("ended"))
    # equal rows of one turn are neighbours: one row with a number of copies
    groups = narrow.groupBy("key", "turn", "role", "digest").agg(
        F.first("conv_id").alias("conv_id"), F.sum("copies").cast("int").alias("copies"), *[F.first(c).alias(c) for c in ("initial", "blank", "ended")])
    groups = materialize(groups)
    earliest = groups.filter("copies > 0 and not blank").groupBy("key", "role", "digest").agg(
        F.min(F.struct("turn")).alias("earliest"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    marked = groups.join(earliest, ["key", "role", "digest"], "left")
    first = F.col("earliest").isNull() | (F.col("earliest") == F.struct("turn")) | (F.col("earliest.turn").isNull() & F.col("turn").isNull())
    stays = F.col("copies") > 0
    marked = marked.select(
        "key", "conv_id", F.when(stays, F.col("turn")).alias("known"), F.struct("turn", "role", "digest", _letters(first, F.col("copies")).alias("letters")).alias("at"))
    ranged = marked.repartitionByRange("key", F.col("at.turn").asc_nulls_first(), "at.role", "at.digest").withColumn("idx", F.spark_partition_id())
    chunks = ranged.groupBy("key", "idx").agg(
        F.first("conv_id").alias("conv_id"), F.array_join(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["letters"]), "").alias("letters"),
        F.min("known").alias("first_turn"), F.max("known").alias("last_turn"), F.size(F.collect_set("known")).cast("long").alias("turns"))
    level = materialize(chunks.select("key", "conv_id", "idx", _chunk_column()("letters", "first_turn", "last_turn", "turns").alias("e")))
    parts = level.agg(F.max("idx")).first()[0] or 0
    while parts > 0:
        parts //= FAN
        groups = level.groupBy("key", (F.col("idx") / FAN).cast("int").alias("idx")).agg(
            F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("idx", "e"))).alias("g"))
        alone = F.size("g") == 1
        level = materialize(
            groups.filter(alone).select("key", "conv_id", "idx", F.col("g")[0]["e"].alias("e"))
            .unionByName(groups.filter(~alone).select("key", "conv_id", "idx", _tree_column()("g").alias("e"))))
    gaps = F.coalesce(F.col("e.last_turn") - F.col("e.first_turn") + 1 - F.col("e.turns"), F.lit(0))
    return level.withColumn("_b", _best_column()("e")).select(
        "key", "conv_id", gaps.alias("gaps"), F.col("e.n_blank").alias("blank"), F.col("e.n_duplicate").alias("duplicate"),
        F.col("e.n_truncated").alias("truncated"), F.col("e.illegal").alias("illegal"), "_b.cost", "_b.audit")


class _Repair:
    """Follows an audit row by row and gives the turns of the repaired conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _follow(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._follow(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._follow(), text
        elif edit == "K":
            self.state = {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT)
            yield role, text


PLAN = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _stream(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Plans and rows in one table, a conversation's plan before its rows, all in one task and in order."""
    none = {c: F.lit(None).cast(t).alias(c) for c, t in plan.dtypes}
    heads = plan.select("key", *PLAN, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("digest", "binary"))])
    body = rows.filter("copies > 0").select("key", *[none[c] for c in PLAN], F.lit(1).alias("kind"), "turn", "role", "text", _digest(), "copies")
    body = body.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "_copy")
    order = ["key", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    return heads.unionByName(body).repartition("key").sortWithinPartitions(*order).drop("turn", "digest", "key")



def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, position`` (from 1), ``role, text``."""
    kind = plan.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, conv, position = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for r in batch.select(["conv_id", "audit", "kind", "role", "text"]).to_pylist():
                if r["kind"] == 0:
                    if repair is not None:
                        tail = list(repair.inserted())
                        out += [(conv, position + i + 1, *t) for i, t in enumerate(tail)]
                    repair, conv, position = _Repair(r["audit"]), r["conv_id"], 0
                    continue
                for t in repair.row(r["role"], r["text"]):
                    position += 1
                    out.append((conv, position, *t))
            yield _batch(out, batch.schema.field("conv_id").type)
            last = batch.schema.field("conv_id").type
        if repair is not None:
            yield _batch([(conv, position + i + 1, *t) for i, t in enumerate(repair.inserted())], last)

    def _batch(out: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [(), (), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], conv_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["conv_id", "position", "role", "text"])

    return _stream(rows, plan).mapInArrow(run, f"conv_id {kind}, position bigint, role string, text string")


def _with_digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` without its key, plus ``repaired_sha256`` over ``role:text`` lines of the repaired turns."""
    schema = ", ".join([f"{c} {plan.schema[c].dataType.simpleString()}" for c in PLAN] + ["repaired_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, digest, head, any_turn = None, None, None, False

        def add(turns) -> None:
            nonlocal any_turn
            for role, text in turns:
                digest.update(f"{chr(10) if any_turn else ''}{role}:{text}".encode())
                any_turn = True

        fields = None
        for batch in batches:
            fields = pa.schema([batch.schema.field(c) for c in PLAN] + [pa.field("repaired_sha256", pa.string())])
            done = []
            heads = batch.column("kind").to_pylist()
            plan_rows = batch.select(list(PLAN)).filter(pa.array([k == 0 for k in heads])).to_pylist()
            at = 0
            for k, role, text in zip(heads, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if k == 0:
                    if head is not None:
                        add(repair.inserted())
                        done.append({**head, "repaired_sha256": digest.hexdigest()})
                    head, at = plan_rows[at], at + 1
                    repair, digest, any_turn = _Repair(head["audit"]), hashlib.sha256(), False
                else:
                    add(repair.row(role, text))
            yield pa.RecordBatch.from_pylist(done, schema=fields)
        if head is not None:
            add(repair.inserted())
            yield pa.RecordBatch.from_pylist([{**head, "repaired_sha256": digest.hexdigest()}], schema=fields)

    return _stream(rows, plan).mapInArrow(run, schema)


def repair_rows(conversations: DataFrame) -> DataFrame:
    """The contract's columns: damage, plan and digest, one row for every original conversation."""
    rows = damaged(as_rows(conversations))
    return _with_digests(rows, plans(rows))
