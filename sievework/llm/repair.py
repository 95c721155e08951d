"""Repair of the turn structure of conversations by weighted interval parsing.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``: an optional system
turn, then user and assistant in turn, or nothing at all. Edits: Keep (cost 0), Rerole to user or
assistant (1), Delete (2; blank and duplicate rows must be deleted), Insert an empty user or
assistant turn anywhere (5). A truncated row that is not deleted adds 5. Of the cheapest edits the
one whose audit, the string of their initials in order, is least in ASCII is taken.

The grammar has a nonterminal N[p, q] for two places of the role pattern (0 nothing yet, 1 after the
system turn, 2 after a user turn, 3 after an assistant turn), which derives the roles that lead from
p to q. In Chomsky normal form its rules are N[p, q] -> N[p, r] N[r, q] for every r, and N[p, q] -> one
edited row; N[0, 0] and N[0, 3] are the start. A cell of a span is the least (cost, audit) of every
N[p, q], closed under insertions on both sides. Spans are combined bottom-up, shorter ones first.
Any split point of a span gives the same cells in this grammar, so one split a span is enough and
the work grows with n, not n^3: ``span`` halves, and the pieces of a long conversation are paired
like the digits of a binary counter.

In Spark: rows are reduced to (conversation, turn, initial, fault, digest), equal ones counted
before the shuffle; a duplicate is a row after the first one of its digest (an aggregation and a
join). The reduced rows are sorted by range, so a conversation of any size is dealt over partitions,
and cut into pieces of at most ``PIECE`` rows whose cells are made in parallel. What one task sees
of one conversation is a piece at a time, and the audit, which is one value of the result. Texts meet
their edits again by digest.

Rows are ordered by turn (null first); rows of one turn by their role's initial, then by a digest of
role and text. Null roles and texts count as one space, a null conversation is one of its own. A role
that is empty or has another initial than s, u, a can not be kept. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import SPACES, WORD, arrow_schema, partitions, written

#: Costs of the edits and what the role pattern allows after each place.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = ("su", "ua", "au")
#: Rows of a conversation that are one piece.
PIECE = 1024

#: cells[p][q] is the least (cost, audit) or None.
Cells = tuple[tuple[tuple[int, str] | None, ...], ...]


def _table(found: dict[tuple[int, int], tuple[int, str]]) -> Cells:
    return tuple(tuple(found.get((p, q)) for q in range(4)) for p in range(4))


def combine(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts."""
    out = []
    for row in left:
        best = [None] * 4
        for r, first in enumerate(row):
            if first is None:
                continue
            cost, audit = first
            for q, second in enumerate(right[r]):
                if second is None:
                    continue
                total = cost + second[0]
                old = best[q]
                if old is None or total < old[0] or (total == old[0] and audit + second[1] < old[1]):
                    best[q] = (total, audit + second[1])
        out.append(tuple(best))
    return tuple(out)


def _insertions() -> Cells:
    """Nothing, or the shortest run of inserted turns that leads from p to q."""
    single = {(p, q): (INSERT, "I") for (p, role), q in STEP.items() if role in "ua"}
    closed = _table({(p, p): (0, "") for p in range(4)} | single)
    return combine(closed, closed)


CLOSURE = _insertions()


def row_cells(symbol: str) -> Cells:
    """Cells of one row: its role's initial (x: no such role), upper case if truncated, D if it must go."""
    found = {(p, p): (DELETE, "D") for p in range(4)}
    if symbol != "D":
        extra = TRUNCATED if symbol.isupper() else 0
        for (p, role), q in STEP.items():
            edits = [(extra, "K")] if role == symbol.lower() else []
            edits += [(REROLE + extra, "R")] if role in "ua" else []
            for edit in edits:
                found[p, q] = min(found.get((p, q), edit), edit)
    return combine(combine(CLOSURE, _table(found)), CLOSURE)


@lru_cache(maxsize=1 << 15)
def _short_span(symbols: str) -> Cells:
    if len(symbols) < 2:
        return row_cells(symbols) if symbols else CLOSURE
    half = len(symbols) // 2
    return combine(_short_span(symbols[:half]), _short_span(symbols[half:]))


def span(symbols: str) -> Cells:
    """Cells of a run of rows, combined bottom-up."""
    if len(symbols) <= 16:
        return _short_span(symbols)
    half = len(symbols) // 2
    return combine(span(symbols[:half]), span(symbols[half:]))


def best_edit(cells: Cells) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(c for c in (cells[0][0], cells[0][3]) if c is not None)


def roles_of(length: int) -> Iterator[str]:
    """The only role initials of that length that fit the pattern."""
    for at in range(length):
        yield "s" if length % 2 and at == 0 else "ua"[(at - length % 2) % 2]


# --- rows --------------------------------------------------------------------------------


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))


def prepared(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text with nulls as one space, and the digest of conversation, role and text."""
    conv, role, text = F.coalesce(F.col("conv").cast("string"), F.lit("")), F.col("role"), F.col("text")
    known = F.col("conv").isNull().cast("int").cast("string")
    sized = F.concat_ws(":", known, F.char_length(conv).cast("string"), conv, F.char_length(role).cast("string"), role, text)
    out = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    return out.withColumn("key", F.unhex(F.md5(sized)))


def _reduced(rows: DataFrame) -> DataFrame:
    """conv, turn, initial, fault, key and how many equal rows there are; duplicates are marked."""
    text = F.col("text")
    tail = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    fault = F.when(~text.rlike(WORD), "b").when(~tail.isin(".", "!", "?"), "t").otherwise("")
    light = rows.groupBy("conv", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "key").agg(F.count("*").alias("n"))
    first = light.groupBy("key").agg(F.min(F.struct("turn")).alias("first"))
    late = F.struct("turn") > F.col("first")
    return light.join(first, "key").withColumn("fault", F.when((F.col("fault") == "") | (F.col("fault") == "t"), F.when(late, "d").otherwise(F.col("fault"))).otherwise(F.col("fault"))).drop("first")


_ROWS = "turns array<long>, initials array<string>, faults array<string>, keys array<binary>, counts array<long>"


def _pieces(rows: DataFrame) -> DataFrame:
    """Pieces of conversations in order of (part, piece), with their rows, symbols and counts."""
    order = ["conv", "turn", "initial", "key"]
    dealt = rows.select(*order, "fault", "n").repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    conv_type = rows.schema["conv"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state = {"piece": 0}
        held: list[tuple] = []

        def flush(full: list[tuple]) -> dict:
            state["piece"] += 1
            return _piece(full, part, state["piece"])

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][0] != row[0] or len(held) >= PIECE):
                    out.append(flush(held))
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([flush(held)], schema)

    ddl = f"conv {conv_type}, part int, piece int, {_ROWS}, symbols string, cells string, size long, blank long, duplicate long, truncated long, illegal long, turn_count long, head string, tail string, low long, high long"
    schema = arrow_schema(ddl)
    return written(dealt.mapInArrow(cut, ddl), "pieces")


def _piece(rows: list[tuple], part: int, piece: int) -> dict:
    """What a piece says: columns of ``rows`` are conv, turn, initial, key, fault, n."""
    symbols = []
    count = dict.fromkeys("bdt", 0)
    illegal, last = 0, None
    for _, _, initial, _, fault, n in rows:
        own = initial if initial in ("s", "u", "a") else "x"
        symbols.append(("D" if fault in ("b", "d") else own.upper() if fault == "t" else own) + "D" * (n - 1))
        if fault == "b":
            count["b"] += n
        else:
            if fault:
                count[fault] += 1
            count["d"] += n - 1
        illegal += n - 1 + (last is not None and last + initial not in LEGAL)
        last = initial
    text = "".join(symbols)
    turns = {r[1] for r in rows if r[1] is not None}
    return {
        "conv": rows[0][0],
        "part": part,
        "piece": piece,
        "turns": [r[1] for r in rows],
        "initials": [r[2] for r in rows],
        "faults": [r[4] for r in rows],
        "keys": [r[3] for r in rows],
        "counts": [r[5] for r in rows],
        "symbols": text,
        "cells": json.dumps(span(text)) if len(text) > 64 else None,
        "size": len(text),
        "blank": count["b"],
        "duplicate": count["d"],
        "truncated": count["t"],
        "illegal": illegal,
        "turn_count": len(turns),
        "head": rows[0][2],
        "tail": last,
        "low": min(turns, default=None),
        "high": max(turns, default=None),
    }


class _Conversation:
    """Pieces of one conversation as they come in order."""

    def __init__(self):
        self.stack: list[tuple[int, Cells]] = []
        self.pieces: list[tuple[int, int, int]] = []
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turn_count"), 0)
        self.low = self.high = self.tail = None

    def add(self, r: dict) -> None:
        cells = json.loads(r["cells"]) if r["cells"] is not None else span(r["symbols"])
        self.stack.append((1, cells))
        while len(self.stack) > 1 and self.stack[-2][0] <= self.stack[-1][0]:
            (m, a), (n, b) = self.stack[-2:]
            self.stack[-2:] = [(m + n, combine(a, b))]
        self.pieces.append((r["part"], r["piece"], r["size"]))
        for name in self.sums:
            self.sums[name] += r[name]
        if self.tail is not None:
            self.sums["illegal"] += self.tail + r["head"] not in LEGAL
        self.tail = r["tail"]
        if r["low"] is not None:
            self.sums["turn_count"] -= self.high is not None and self.high == r["low"]
            self.low = r["low"] if self.low is None else self.low
            self.high = r["high"]

    def rows(self, conv) -> Iterator[dict]:
        """A row per piece with its part of the audit; the first one has the report too."""
        _, cells = self.stack.pop()
        while self.stack:
            cells = combine(self.stack.pop()[1], cells)
        cost, audit = best_edit(cells)
        distinct = self.sums.pop("turn_count")
        gaps = self.high - self.low + 1 - distinct if distinct else 0
        length = len(audit) - audit.count("D")
        report = {"gaps": gaps, **self.sums, "cost": cost, "audit": audit}
        at = place = 0
        for number, (part, piece, size) in enumerate(self.pieces):
            start, left = at, size
            while left:
                left -= audit[at] != "I"
                at += 1
            if number == len(self.pieces) - 1:
                at = len(audit)
            own = audit[start:at]
            yield {"conv": conv, "part": part, "piece": piece, "place": place, "length": length, "edits": own} | (report if number == 0 else {})
            place += len(own) - own.count("D")


def _parse(pieces: DataFrame) -> DataFrame:
    conv_type = pieces.schema["conv"].dataType.simpleString()
    ddl = (
        f"conv {conv_type}, part int, piece int, place long, length long, edits string, "
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    )
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if open_ is not None and r["conv"] != conv:
                    out += open_.rows(conv)
                    open_ = None
                if open_ is None:
                    open_, conv = _Conversation(), r["conv"]
                open_.add(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if open_ is not None:
            yield pa.RecordBatch.from_pylist(list(open_.rows(conv)), schema)

    light = pieces.drop("turns", "initials", "faults", "keys", "counts")
    dealt = light.repartition(partitions(pieces), "conv").sortWithinPartitions("conv", "part", "piece")
    return written(dealt.mapInArrow(run, ddl), "edits")


class Repair:
    """Parsed conversations: ``report`` and ``repaired`` are DataFrames of them."""

    def __init__(self, rows: DataFrame):
        self.prepared = prepared(rows)
        self.pieces = _pieces(_reduced(self.prepared))
        self.edits = _parse(self.pieces)

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation."""
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        return self.edits.filter(F.col("audit").isNotNull()).select(F.col("conv").alias("conv_id"), *names)

    def repaired(self) -> DataFrame:
        """conv_id, place, edit, turn, role, text: the rows after the edits, in place order from 0."""
        both = self.pieces.select("part", "piece", "turns", "keys", "counts").join(
            self.edits.select("part", "piece", "conv", "place", "length", "edits"), ["part", "piece"]
        )
        conv_type = self.edits.schema["conv"].dataType.simpleString()
        ddl = f"conv {conv_type}, place long, edit string, turn long, key binary, new_role string"
        schema = arrow_schema(ddl)

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    out += _apply(r)
                    if len(out) >= 4 * PIECE:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

        # One key for both the aggregation and the join, so that texts are shuffled once.
        row = F.concat("key", F.encode(F.coalesce(F.col("turn").cast("string"), F.lit("")), "UTF-8"))
        edits = both.mapInArrow(expand, ddl).withColumn("row", row).drop("key")
        texts = self.prepared.groupBy(row.alias("row")).agg(F.first("role").alias("role"), F.first("text").alias("text"))
        return edits.join(texts, "row", "left").select(
            F.col("conv").alias("conv_id"), "place", "edit", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
        )


def _apply(r: dict) -> Iterator[dict]:
    """Rows that stay or come in one piece."""
    place, length, row, copies = r["place"], r["length"], 0, 0
    for edit in r["edits"]:
        # An inserted row has a key of its own that no text has, so such rows are spread over the join.
        turn, key = (None, f"{r['part']}:{r['piece']}:{place}".encode()) if edit == "I" else (r["turns"][row], r["keys"][row])
        if edit != "D":
            initial = "s" if length % 2 and place == 0 else "ua"[(place - length % 2) % 2]
            new = {"u": "user", "a": "assistant"}[initial] if edit in "IR" else None
            yield {"conv": r["conv"], "place": place, "edit": edit, "turn": turn, "key": key, "new_role": new}
            place += 1
        if edit != "I":
            copies += 1
            if copies == r["counts"][row]:
                row, copies = row + 1, 0


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of ``role:text`` of its rows, joined by newlines; rows are streamed in order."""
    conv_type = repaired.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {conv_type}, repaired_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, conv = None, None
        for batch in batches:
            out = []
            for own, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if sha is not None and own != conv:
                    out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                    sha = None
                if sha is None:
                    sha, conv = hashlib.sha256(line.encode()), own
                else:
                    sha.update(b"\n" + line.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if sha is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": sha.hexdigest()}], schema)

    lines = repaired.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition(partitions(lines), "conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, ddl)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text,
    2 removes its ``[.!?]``, 3 repeats it, 4 sets role user; other rows stay."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    code = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    rows = rows.withColumn("__code", code).filter(F.col("__code") != 0)
    text = F.when(F.col("__code") == 1, F.lit("")).when(F.col("__code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__code") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("__code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("__time")).drop("__time")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """One row for every conversation of the table: what its damaged rows say, the edits, and the digest of the repair."""
    found = Repair(damage(conversations))
    report = found.report().withColumnRenamed("conv_id", "conv")
    digests = repaired_digests(found.repaired()).withColumnRenamed("conv_id", "conv")
    every = conversations.select("conv_id").distinct()
    out = every.join(report, F.col("conv_id").eqNullSafe(F.col("conv")) & F.col("audit").isNotNull(), "left").drop("conv")
    out = out.join(digests, F.col("conv_id").eqNullSafe(F.col("conv")) & F.col("repaired_sha256").isNotNull(), "left").drop("conv")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
