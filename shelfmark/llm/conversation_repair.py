"""Cheapest repair of the turn structure of conversations by lazy determinisation.

A well-formed conversation has the role initials ``(s?(ua)+)?``.  Its automaton has
four states: START, SYSTEM (a system turn only), ASKED (an assistant turn must come) and
DONE.  Edits are weighted arcs: Keep 0, Rerole to user or assistant 2, Delete 3 (the only
one for blank and duplicate rows), Insert an empty user or assistant turn 2; a truncated
row that is not deleted adds 1.

1. The costs of the four states, less the least of them, are one *vector*.  Vectors are
   the states of a deterministic automaton that is made as rows ask for it: a table
   remembers for (vector, symbol) the next vector and what was taken off.  Entries more
   than 5 above the least can never come back (a system turn kept saves at most 3, a
   turn inserted costs 2), so that there are few vectors.  Costs come from this scan,
   one look-up a row.
2. Backwards from the cheapest accepting states, arcs whose cost equals the difference of
   their ends (tight arcs) mark the states that cheapest repairs pass.  Forwards over the
   marked ones the first letter of D, I, K, R in the alphabet is taken.  As each letter
   leads from a state to one state, that is the least audit.  Both are look-ups, too.

Rows are put in order by Spark (conversation, turn, then role and SHA-256 of role and
text) and streamed.  A task keeps one byte a row of the conversation in hand, as the
audit itself does; texts are streamed in a second pass that applies the audit and hashes
them.  SHA-256 of a whole conversation can't be split, so one conversation is one stream
however long; which of its rows are duplicates is worked out by aggregation and join.

Defined results: null role or text is one space; a null turn comes first; a null conv_id
is a conversation; rows of one turn follow each other by role, then by digest; repeated
rows are duplicates of the first; other columns are not read, but for ``there``, a
column that may be named: false for rows that are gone.  A conversation without rows left has zeros, an empty audit and the hash of the empty string.  An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textkit

START, SYSTEM, ASKED, DONE = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Where a user or assistant turn, whichever may come, leads from each state.
_NEXT = (ASKED, ASKED, DONE, ASKED)
_ROLE_OF = {ASKED: "user", DONE: "assistant"}
#: A vector's entries further above its least are never part of a cheapest repair.
_FAR = 5
_NEVER = 1 << 30
#: A symbol is an initial (0 s, 1 u, 2 a, 3 other), plus 4 if truncated; or MUST, to be deleted.
MUST = 8
_SPACE = " \t\n\x0b\f\r"


def _kept(state: int, initial: int) -> int | None:
    """Where keeping a row with this initial leads."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return ASKED if state != ASKED else None
    return DONE if initial == 2 and state == ASKED else None


def _arcs(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of the edits of a row, letters in order."""
    if symbol == MUST:
        return [("D", state, DELETE)]
    extra = TRUNCATED if symbol & 4 else 0
    found = [("D", state, DELETE), ("R", _NEXT[state], REROLE + extra)]
    to = _kept(state, symbol & 3)
    if to is not None:
        found.insert(1, ("K", to, KEEP + extra))
    return found


class Repairer:
    """The lazily made automaton and its tables."""

    def __init__(self) -> None:
        self._numbers: dict[tuple, int] = {}
        self._vectors: list[tuple] = []
        self._after: dict[tuple[int, int], tuple[int, int]] = {}
        self._before: dict[tuple[int, int, int], int] = {}
        self._choice: dict[tuple[int, int, int, int], tuple[str, int]] = {}
        self.first, _ = self._vector([0, _NEVER, _NEVER, _NEVER])

    def _vector(self, costs: list[int]) -> tuple[int, int]:
        """Number of the vector after insertions, and what was taken off."""
        costs = list(costs)
        costs[ASKED] = min(costs[ASKED], *(costs[q] + INSERT for q in (START, SYSTEM, DONE)))
        costs[DONE] = min(costs[DONE], costs[ASKED] + INSERT)
        least = min(costs)
        key = tuple(c - least if c - least <= _FAR else _NEVER for c in costs)
        if key not in self._numbers:
            self._numbers[key] = len(self._vectors)
            self._vectors.append(key)
        return self._numbers[key], least

    def _step(self, number: int, symbol: int) -> tuple[int, int]:
        costs = [_NEVER] * 4
        for state, cost in enumerate(self._vectors[number]):
            if cost < _NEVER:
                for _, to, more in _arcs(state, symbol):
                    costs[to] = min(costs[to], cost + more)
        found = self._after[number, symbol] = self._vector(costs)
        return found

    def _inserted(self, number: int, mask: int) -> int:
        """Marked states, and those that tight insertions lead from to them."""
        vector = self._vectors[number]
        for _ in range(2):
            for q in range(4):
                if vector[q] < _NEVER and mask >> _NEXT[q] & 1 and vector[q] + INSERT == vector[_NEXT[q]]:
                    mask |= 1 << q
        return mask

    def _marked(self, number: int, symbol: int, mask: int) -> int:
        """States before a row that tight arcs lead from to the marked ones after it."""
        after, off = self._after[number, symbol]
        before, behind, out = self._vectors[number], self._vectors[after], 0
        for q in range(4):
            if before[q] < _NEVER and any(mask >> to & 1 and before[q] + cost == off + behind[to] for _, to, cost in _arcs(q, symbol)):
                out |= 1 << q
        out = self._before[number, symbol, mask] = self._inserted(number, out)
        return out

    def _chosen(self, number: int, symbol: int, state: int, mask: int) -> tuple[str, int]:
        """Letters up to and with a row's own, and the state after it."""
        after, off = self._after[number, symbol]
        here, before, behind = self._before[number, symbol, mask], self._vectors[number], self._vectors[after]
        letters, q = "", state
        while True:
            tight = [(letter, to, True) for letter, to, cost in _arcs(q, symbol) if mask >> to & 1 and before[q] + cost == off + behind[to]]
            if here >> _NEXT[q] & 1 and before[q] + INSERT == before[_NEXT[q]]:
                tight.append(("I", _NEXT[q], False))
            letter, q, over = min(tight)
            letters += letter
            if over:
                break
        found = self._choice[number, symbol, state, mask] = (letters, q)
        return found

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """(cost, audit) of a conversation."""
        number, total, passed = self.first, 0, array("H")
        for symbol in symbols:
            passed.append(number)
            found = self._after.get((number, symbol)) or self._step(number, symbol)
            number, off = found
            total += off
        last = self._vectors[number]
        least = min(last[START], last[DONE])
        mask = self._inserted(number, sum(1 << q for q in (START, DONE) if last[q] == least))
        masks = bytearray(len(symbols))
        for i in range(len(symbols) - 1, -1, -1):
            masks[i] = mask
            key = (passed[i], symbols[i], mask)
            found = self._before.get(key)
            mask = self._marked(*key) if found is None else found
        audit, state = [], START
        for i, symbol in enumerate(symbols):
            letters, state = self._choice.get((passed[i], symbol, state, masks[i])) or self._chosen(passed[i], symbol, state, masks[i])
            audit.append(letters)
        while not (state in (START, DONE) and last[state] == least):
            audit.append("I")
            state = _NEXT[state]
        return total + least, "".join(audit)


def applied(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn that stands after the edits."""
    state = START
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            yield letter, _ROLE_OF[state], ""
            continue
        role, text = next(rows)
        if letter == "R":
            state = _NEXT[state]
            yield letter, _ROLE_OF[state], text
        elif letter == "K":
            state = _kept(state, "sua".find(role[:1]))
            yield letter, role, text


def _clean(conversations: DataFrame, there: str | None) -> DataFrame:
    """conv_id, turn, role, text, digest, and present: false for rows that only name their conversation."""
    present = F.lit(True) if there is None else F.col(there)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.withColumn("digest", digest)


def _symbols(rows: DataFrame) -> DataFrame:
    """Rows without their texts: initial, blank, truncated, and later than the first of their role and text."""
    ends = F.rtrim("text", F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ends == ""
    small = rows.select("conv_id", "turn", "role", "digest", "present", code.cast("byte").alias("initial"), blank.alias("blank"), (~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    firsts = small.filter("present").groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min("turn").alias("_turn"), F.max(F.col("turn").isNull()).alias("_none"))
    joined = small.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    later = F.col("turn").isNotNull() & (F.col("_none") | (F.col("turn") > F.col("_turn")))
    return joined.select("conv_id", "turn", "role", "digest", "present", "initial", "blank", "truncated", F.coalesce(later, F.lit(False)).alias("later"))



def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Conversations whole in a partition, their rows in order."""
    n = store.partitions(rows.sparkSession)
    return rows.repartition(n, "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *first, F.asc_nulls_first("turn"), "role", "digest")


class _Conversation:
    """What is gathered of the conversation in hand."""

    def __init__(self, conv_id: object):
        self.conv_id, self.symbols, self.initials = conv_id, bytearray(), bytearray()
        self.blank = self.duplicate = self.truncated = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, turn: int | None, digest: bytes, initial: int, blank: bool, truncated: bool, later: bool) -> None:
        again = later or (self.last is not None and self.last == (turn, digest))
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last = (turn, digest)
        self.initials.append(initial)
        if blank or again:
            self.blank += blank
            self.duplicate += not blank
            self.symbols.append(MUST)
        else:
            self.truncated += truncated
            self.symbols.append(initial | (4 if truncated else 0))

    def result(self, repairer: Repairer) -> tuple:
        pairs = np.frombuffer(bytes(self.initials), np.uint8).astype(np.int16)
        legal = np.isin(pairs[:-1] * 4 + pairs[1:], (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = repairer.repair(bytes(self.symbols))
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, int((~legal).sum()), cost, audit


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _judge(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, now, out = Repairer(), None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for rows in batches:
            for conv_id, turn, digest, present, initial, blank, truncated, later in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "digest", "present", "initial", "blank", "truncated", "later")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.result(repairer))
                    now = _Conversation(conv_id)
                if present:
                    now.add(turn, digest, initial, blank, truncated, later)
            if len(out) >= 1000:
                yield batch()
        if now is not None:
            out.append(now.result(repairer))
            yield batch()

    return run


def judge(conversations: DataFrame, there: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation."""
    return _judged(_clean(conversations, there))


def _judged(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    ddl = f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"
    return _in_order(_symbols(rows)).mapInArrow(textkit.tidy(_judge(_arrow(rows.sparkSession, ddl))), ddl)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _with_audits(rows: DataFrame) -> DataFrame:
    """Each conversation's judgement, then its rows in order."""
    judged = _judged(rows)
    nothing = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("turn", "role", "text", "digest")}
    heads = judged.select("conv_id", F.lit(0).alias("at"), F.struct(*_COUNTS, "audit").alias("judged"), *[v.alias(c) for c, v in nothing.items()])
    body = rows.filter("present").select("conv_id", F.lit(1).alias("at"), F.lit(None).cast(heads.schema["judged"].dataType).alias("judged"), "turn", "role", "text", "digest")
    return _in_order(heads.unionByName(body), "at")


class _Turns:
    """Streams ordered rows: the rows of one conversation at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.rows = (row for batch in batches for part in textkit.pieces(iter([batch])) for row in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "at", "judged", "role", "text")), strict=True))
        self.head = next(self.rows, None)

    def __iter__(self) -> Iterator[tuple]:
        while self.head is not None:
            conv_id, _, judged, _, _ = self.head
            yield conv_id, judged, self._texts()
            # all rows of a conversation have been read: its audit has a letter for each

    def _texts(self) -> Iterator[tuple[str, str]]:
        self.head = None
        for row in self.rows:
            if row[1] == 0:
                self.head = row
                return
            yield row[3], row[4]


def repair(conversations: DataFrame, there: str | None = None) -> DataFrame:
    """``judge``'s columns and repaired_sha256: of the repaired ``role:text`` lines joined by newlines."""
    rows = _clean(conversations, there)
    kind = rows.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    schema = _arrow(rows.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for conv_id, judged, texts in _Turns(batches):
            digest, between = hashlib.sha256(), b""
            for _, role, text in applied(judged["audit"], texts):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            for _ in texts:  # reads on to the next conversation
                raise ValueError("an audit has a letter for each row")
            out.append((conv_id, *(judged[c] for c in _COUNTS), judged["audit"], digest.hexdigest()))
            if len(out) >= 1000:
                yield batch()
        if out:
            yield batch()

    return _with_audits(rows).mapInArrow(textkit.tidy(run), ddl)


def turns(conversations: DataFrame, there: str | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text."""
    rows = _clean(conversations, there)
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, edit string, role string, text string"
    schema = _arrow(rows.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for conv_id, judged, texts in _Turns(batches):
            for place, (edit, role, text) in enumerate(applied(judged["audit"], texts)):
                out.append((conv_id, place, edit, role, text))
                size += len(text) + 64
                if size >= textkit.CHUNK_BYTES:
                    yield batch()
                    size = 0
            for _ in texts:
                raise ValueError("an audit has a letter for each row")
        if out:
            yield batch()

    return _with_audits(rows).mapInArrow(textkit.tidy(run), ddl)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated and given another role, by the CRC-32 of ``conv_id:turn``.

    A dropped row stays as one that is not present, so that its conversation is named.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("_fate"))
    fate = F.col("_fate")
    rows = rows.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (fate != 0).alias("present"), F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    return rows.drop("_copy")


