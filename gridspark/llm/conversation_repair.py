"""Conversation structure repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`.

Roles count by their initials. Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or
assistant row 2; a truncated row that is not deleted adds 1; blank rows and duplicates must go. So the edits are a weighted
automaton over four places (nothing yet, after s, after u, after a), and a conversation is a word of row symbols: the
class of its initial and its fault.

The automaton is determinised lazily: a state is the vector of the cheapest costs of the four places, less their
minimum, and the step from a state under a symbol is worked out when it first comes up and then kept in a table. Costs
more than SLACK above the minimum are dropped (from any place, whatever another place can still do costs at most 5
more), so there are few states. A scan of the table gives the cost; a trace back along tight arcs (those on which costs
add up) marks the places on cheapest paths; going forward over marked places by the least letter gives the ASCII-least
audit, as a letter leads from a place to one place.

Faults are worked out in Spark: the first row of each (conversation, role, text) by a grouped minimum, so rows that recur
are counted before anything is brought together. A conversation's rows then pass through one task in their order, first
as symbols alone (about four bytes a row are held), then as texts, each written on or hashed as it comes. No task holds a
conversation's texts; its audit is one value of the result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import map_batches, stash, table_of

SLACK = 5
_INF = 1 << 20
#: Places: 0 nothing yet, 1 after s, 2 after u, 3 after a. The place after an inserted or reroled row, and its role.
_TURN = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_END = (0, 3)
#: Classes of initials: s, u, a, any other. Kinds of rows.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
_KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
#: Pairs of classes that may stand side by side: su, ua, au.
_LEGAL = {(0, 1), (1, 2), (2, 1)}
SPACE = "\\x20\\x09-\\x0D"


def _arcs(place: int, symbol: int) -> list[tuple[str, int, int]]:
    """(letter, next place, cost) of a row's edits at a place, letters ascending."""
    kind, role = symbol % 4, symbol // 4
    out = [("D", place, 3)]
    if kind in (FINE, TRUNCATED):
        if place in _KEEP[role]:
            out.append(("K", _KEEP[role][place], int(kind == TRUNCATED)))
        out.append(("R", _TURN[place], 2 + int(kind == TRUNCATED)))
    return out


class Repairs:
    """The determinised automaton, as far as words have needed it."""

    def __init__(self) -> None:
        first, _ = self._normal([0, _INF, _INF, _INF])
        self.vectors = [first]
        self._number = {first: 0}
        self._next: dict[int, tuple[int, int]] = {}
        self._back: dict[tuple[int, int, int], int] = {}

    @staticmethod
    def _normal(v: list[int]) -> tuple[tuple[int, ...], int]:
        """The vector with insertions, less its minimum, without costs that no cheapest path has; and the minimum."""
        for _ in range(len(v)):
            for p, q in enumerate(_TURN):
                v[q] = min(v[q], v[p] + 2)
        least = min(v)
        return tuple(x - least if x - least <= SLACK else _INF for x in v), least

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and what the minimum grows by."""
        found = self._next.get(state * 16 + symbol)
        if found is None:
            v = [_INF] * 4
            for p, cost in enumerate(self.vectors[state]):
                for _, q, more in _arcs(p, symbol):
                    v[q] = min(v[q], cost + more)
            vector, least = self._normal(v)
            if vector not in self._number:
                self._number[vector] = len(self.vectors)
                self.vectors.append(vector)
            found = self._next[state * 16 + symbol] = self._number[vector], least
        return found

    def _with_inserts(self, v: tuple[int, ...], marked: int) -> int:
        for _ in range(len(v)):
            for p, q in enumerate(_TURN):
                if marked >> q & 1 and v[p] < _INF and v[p] + 2 == v[q]:
                    marked |= 1 << p
        return marked

    def _marked(self, state: int, symbol: int, after: int) -> int:
        """Places before a row from which a tight arc leads to a marked place after it."""
        key = state, symbol, after
        if key not in self._back:
            v, (to, least) = self.vectors[state], self.step(state, symbol)
            found = sum(1 << p for p in range(4) if v[p] < _INF and any(after >> q & 1 and v[p] + cost == self.vectors[to][q] + least for _, q, cost in _arcs(p, symbol)))
            self._back[key] = self._with_inserts(v, found)
        return self._back[key]

    def repair(self, word: bytes | bytearray) -> tuple[int, str]:
        """Cost and ASCII-least audit of the cheapest edits."""
        states, cost = array("H", [0]), 0
        for symbol in word:
            state, more = self.step(states[-1], symbol)
            states.append(state)
            cost += more
        v = self.vectors[states[-1]]
        last = min(v[q] for q in _END)
        marks = bytearray(len(states))
        marks[-1] = self._with_inserts(v, sum(1 << q for q in _END if v[q] == last))
        for i in range(len(word) - 1, -1, -1):
            marks[i] = self._marked(states[i], word[i], marks[i + 1])
        audit, place, i = [], 0, 0
        while i < len(word) or not (place in _END and v[place] == last):
            here = self.vectors[states[i]]
            choices = []
            if here[place] + 2 == here[_TURN[place]] and marks[i] >> _TURN[place] & 1:
                choices.append(("I", _TURN[place], 0))
            if i < len(word):
                to, least = self.step(states[i], word[i])
                choices += [(letter, q, 1) for letter, q, c in _arcs(place, word[i]) if marks[i + 1] >> q & 1 and here[place] + c == self.vectors[to][q] + least]
            letter, place, eaten = min(choices)
            audit.append(letter)
            i += eaten
        return cost + last, "".join(audit)


def _text(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(" "))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, times: rows damaged by crc32 of `conv:turn` modulo 20 (nulls: one space).

    0 drops a row (times 0), 1 empties its text, 2 takes its [.!?] out, 3 repeats it (times 2), 4 makes its role user.
    """
    draw = F.crc32(F.concat(_text(conv), F.lit(":"), _text(turn)).cast("binary")) % 20
    changed = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(_text(text), "[.!?]", "")).otherwise(_text(text))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(draw == 4, "user").otherwise(_text(role)).alias("role"), changed.alias("text"), F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).cast("long").alias("times"))


def _prepared(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, times, and a hash of the text in two numbers."""
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    kept = rows.select("conv", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), times.cast("long").alias("times"))
    return kept.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


_ORDER = [F.asc_nulls_first, F.asc, F.asc, F.asc]


def _in_order(rows: DataFrame, *before: str) -> DataFrame:
    """Each conversation in one partition, its rows by turn (null first); those of a turn by role and hash of the text."""
    by = [f(c) for f, c in zip(_ORDER, ("turn", "role", "h1", "h2"))]
    return rows.repartition("conv").sortWithinPartitions("conv", *before, *by)


def _symbols(rows: DataFrame) -> DataFrame:
    """conv, turn, symbol, again (the symbol of the copies), times, in order; equal rows of a turn are one row."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK).when(F.col("text").rlike(f"[.!?][{SPACE}]*\\z"), FINE).otherwise(TRUNCATED)
    small = rows.select("conv", "turn", "role", "h1", "h2", "times", role.alias("cls"), kind.alias("kind"))
    small = stash(small.groupBy("conv", "turn", "role", "h1", "h2").agg(F.sum("times").alias("times"), F.min("cls").alias("cls"), F.min("kind").alias("kind")), "rows")
    first = small.where("times > 0").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.min(F.struct("turn")).alias("first"))
    joined = small.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    repeat = F.when(F.col("kind") == BLANK, BLANK).otherwise(DUPLICATE)
    own = F.when(F.struct("turn").eqNullSafe(F.col("first")), F.col("kind")).otherwise(repeat)
    out = joined.select("conv", "turn", "role", "h1", "h2", "times", (F.col("cls") * 4 + own).alias("symbol"), (F.col("cls") * 4 + repeat).alias("again"))
    return _in_order(out).select("conv", "turn", "symbol", "again", "times")


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _rows(batches, *columns: int) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in columns))


class _Counts:
    """What is counted of one conversation while its symbols go by."""

    def __init__(self) -> None:
        self.word, self.low, self.high, self.turns = bytearray(), None, None, 0

    def add(self, turn: int | None, symbol: int, again: int, times: int) -> None:
        self.word.append(symbol)
        if times > 1:
            self.word += bytes([again]) * (times - 1)
        if turn is not None and turn != self.high:  # turns rise
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def summary(self, repairs: Repairs) -> tuple:
        kinds = [self.word.translate(_KIND_OF).count(k) for k in (BLANK, DUPLICATE, TRUNCATED)]
        classes = self.word.translate(_CLASS_OF)
        illegal = sum((x, y) not in _LEGAL for x, y in zip(classes, classes[1:]))
        return (self.high - self.low + 1 - self.turns if self.turns else 0, *kinds, illegal, *repairs.repair(self.word))


_KIND_OF = bytes(i % 4 for i in range(256))
_CLASS_OF = bytes(i // 4 for i in range(256))


def _summaries(batches, schema: pa.Schema):
    repairs, open_, counts, out = Repairs(), None, _Counts(), []
    for conv, turn, symbol, again, times in _rows(batches, 0, 1, 2, 3, 4):
        if open_ != (conv,):
            if open_:
                out.append((*open_, *counts.summary(repairs)))
            open_, counts = (conv,), _Counts()
            if len(out) == 1024:
                yield table_of(out, schema)
                out = []
        if times:
            counts.add(turn, symbol, again, times)
    if open_:
        yield table_of([*out, (*open_, *counts.summary(repairs))], schema)


def summarise(rows: DataFrame) -> DataFrame:
    """conv and gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation.

    rows: conv, turn, role, text, and times if rows come other than once (0: the row is gone, its conversation is not).
    Null roles and texts count as one space, null turns come first, rows of one turn by role and a hash of the text; null
    conversations are one. Without rows left: zeros and an empty audit. No rows give no rows.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = _symbols(_prepared(rows))
    schema = pa.schema([("conv", _arrow(rows, "conv")), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
    return map_batches(ordered, lambda batches: _summaries(batches, schema), f"conv {kind}, {_SUMMARY}")


def _arrow(rows: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[column].dataType)


def _edited(batches) -> Iterator[tuple]:
    """(True, conv, summary) of each conversation, then (False, edit, role, text) of its rows after the edits, deleted ones too."""
    audit, at, place = "", 0, 0
    for conv, found, role, text, times in _rows(batches, 0, 1, 2, 3, 4):
        if found is not None:
            yield from _inserted(audit, at, place, len(audit))
            yield True, conv, found
            audit, at, place = found["audit"], 0, 0
            continue
        for _ in range(times):
            until = at
            while audit[until] == "I":
                until += 1
            yield from _inserted(audit, at, place, until)
            for _ in range(until - at):
                place = _TURN[place]
            edit, at = audit[until], until + 1
            if edit == "R":
                yield False, edit, _ROLE[place], text
                place = _TURN[place]
            else:
                yield False, edit, role, text
                place = place if edit == "D" else _KEEP["sua".index(role[0])][place]
    yield from _inserted(audit, at, place, len(audit))


def _inserted(audit: str, at: int, place: int, until: int) -> Iterator[tuple]:
    for _ in range(at, until):
        yield False, "I", _ROLE[place], ""
        place = _TURN[place]


def _with_texts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's summary, then its rows in order."""
    texts = _prepared(rows).where("times > 0").select("conv", F.lit(1).alias("part"), "turn", "role", "h1", "h2", F.lit(None).cast(f"struct<{_SUMMARY.replace(' ', ':').replace(',:', ',')}>").alias("found"), "text", "times")
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("h1", "long"), ("h2", "long"))}
    heads = found.select("conv", F.lit(0).alias("part"), *empty.values(), F.struct(*found.columns[1:]).alias("found"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("times"))
    return _in_order(heads.unionByName(texts), "part").select("conv", "found", "role", "text", "times")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv, step, edit, role, text: the rows of every repaired conversation (edit K, R or I), step by step from 0.

    found: what summarise() gives of the same rows.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    schema = pa.schema([("conv", _arrow(rows, "conv")), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        out, held, conv, step = [], 0, None, 0
        for head, *what in _edited(batches):
            if head:
                conv, step = what[0], 0
            elif what[0] != "D":
                out.append((conv, step, *what))
                step, held = step + 1, held + len(what[2])
                if held > 1 << 20 or len(out) == 4096:
                    yield table_of(out, schema)
                    out, held = [], 0
        yield table_of(out, schema)

    return map_batches(_with_texts(rows, found), run, f"conv {kind}, step long, edit string, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with repaired_sha256: of the repaired rows as `role:text`, newlines between, hashed as they go by."""
    kind = rows.schema["conv"].dataType.simpleString()
    names = found.columns[1:]
    schema = pa.schema([("conv", _arrow(rows, "conv")), *((n, pa.int64()) for n in names[:-1]), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        out, open_, digest, begun = [], None, hashlib.sha256(), False
        for head, *what in _edited(batches):
            if head:
                if open_:
                    out.append((*open_, digest.hexdigest()))
                open_, digest, begun = (what[0], *(what[1][n] for n in names)), hashlib.sha256(), False
                if len(out) == 1024:
                    yield table_of(out, schema)
                    out = []
            elif what[0] != "D":
                digest.update(f"{chr(10) * begun}{what[1]}:{what[2]}".encode())
                begun = True
        if open_:
            out.append((*open_, digest.hexdigest()))
        yield table_of(out, schema)

    return map_batches(_with_texts(rows, found), run, f"conv {kind}, {_SUMMARY}, repaired_sha256 string")
