"""Repair of conversation structure by a min-plus matrix scan.

A conversation is well formed if the initials of its roles are ``(s?(ua)+)?``: nothing, or an optional system turn and pairs of user and
assistant. Four states follow these initials, so a turn is a 4 x 4 matrix whose elements are the cheapest (cost, audit) from state
to state: keep, give it another role, delete. Each matrix is closed under inserted turns. The product adds costs, joins audits and takes the
least, which is associative, so turns are multiplied as a tree: inside a partition by halves, across partitions in rounds of FAN
neighbours. Two audits of equal cost over the same turns are never prefixes of each other, so taking the least commutes with joining.

Rows travel by range of (conversation, turn), so a long conversation spreads over many partitions; only digests and flags travel, and the
matrices of conversations that cross a border, two for each partition at most. The texts meet the audits in one ordered pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fine_grained, release, staged

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Cost of each edit, and of a truncated turn that stays.
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_STAYS = 1
#: States: nothing yet, after system, after user, after assistant. A conversation may end in ENDS.
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
ENDS = (0, 3)
#: Neighbouring matrices that one round multiplies, and turns whose product a worker remembers.
FAN, MEMO_TURNS = 8, 8
MOST = (1 << 63) - 1

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]


def times(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product: element (i, j) is the least (cost, audit) over the state in between."""
    out: list[Element] = []
    for i in range(0, 16, 4):
        for j in range(4):
            best, through = None, []
            for k in range(4):
                a, b = x[i + k], y[4 * k + j]
                if a is not None and b is not None:
                    cost = a[0] + b[0]
                    if best is None or cost < best:
                        best, through = cost, [k]
                    elif cost == best:
                        through.append(k)
            out.append(None if best is None else (best, min(x[i + k][1] + y[4 * k + j][1] for k in through)))
    return tuple(out)


def _matrix(edits: list[tuple[int, int, int, str]]) -> Matrix:
    out: list[Element] = [None] * 16
    for i, j, cost, audit in edits:
        if out[4 * i + j] is None or (cost, audit) < out[4 * i + j]:
            out[4 * i + j] = (cost, audit)
    return tuple(out)


def _closure() -> Matrix:
    """Any number of inserted turns: the identity and the one-insert matrix, squared until nothing changes."""
    stay = [(i, i, 0, "") for i in range(4)]
    close = _matrix(stay + [(i, j, COSTS[INSERT], INSERT) for role in "ua" for i, j in STEPS[role]])
    while (more := times(close, close)) != close:
        close = more
    return close


CLOSURE = _closure()
IDENTITY = _matrix([(i, i, 0, "") for i in range(4)])


@lru_cache(maxsize=None)
def turn(code: str) -> Matrix:
    """The matrix of one turn. ``code``: its initial if it may stay, upper case if truncated, ``-`` or ``=`` for another role, ``x`` if it must go."""
    edits = [(i, i, COSTS[DELETE], DELETE) for i in range(4)]
    if code != "x":
        extra = TRUNCATED_STAYS if code.isupper() or code == "=" else 0
        edits += [(i, j, COSTS[KEEP] + extra, KEEP) for i, j in STEPS.get(code.lower(), ())]
        edits += [(i, j, COSTS[REROLE] + extra, REROLE) for role in "ua" for i, j in STEPS[role]]
    return times(_matrix(edits), CLOSURE)


@lru_cache(maxsize=50_000)
def _short(codes: str) -> Matrix:
    if len(codes) < 2:
        return turn(codes) if codes else IDENTITY
    return times(_short(codes[: len(codes) // 2]), _short(codes[len(codes) // 2 :]))


def product(codes: str) -> Matrix:
    """The matrix of a run of turns, by halves."""
    if len(codes) <= MEMO_TURNS:
        return _short(codes)
    half = len(codes) // 2
    return times(product(codes[:half]), product(codes[half:]))


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """(cost, audit) of a whole conversation, inserts before its first turn included."""
    whole = times(CLOSURE, matrix)
    return min(whole[j] for j in ENDS if whole[j] is not None)


# ---- turns as light rows


def damage(turns: DataFrame) -> DataFrame:
    """Plants faults by the hash of conversation and turn: conv_id, turn, role, text and ``copies`` (0: dropped, 2: repeated). Nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(word("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def _cells(turns: DataFrame) -> DataFrame:
    """One row for equal turns: conv_id, turn, role, digest, copies, code of the first of them and whether it is the first with its role and text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    last = F.rtrim(text, F.lit(" \t\n\v\f\r"))
    initial = F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise(F.lit("-"))
    cut = F.when(initial == "-", F.lit("=")).otherwise(F.upper(initial))
    code = F.when(last == "", F.lit("x")).when(F.substring(last, -1, 1).isin(".", "!", "?"), initial).otherwise(cut)
    held = F.coalesce("copies", F.lit(1)) if "copies" in turns.columns else F.lit(1)
    light = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(held > 0, role).otherwise(F.lit("")).alias("role"), F.when(held > 0, _digest(role, text)).alias("digest"),
        initial.alias("initial"), code.alias("code"), held.cast("long").alias("copies"),
    )
    # Equal turns become one row before they travel; a dropped one stays as a mark of its conversation.
    cells = staged(light.groupBy("conv_id", "turn", "role", "digest").agg(F.min("initial").alias("initial"), F.min("code").alias("code"), F.sum("copies").alias("copies")), "cells")
    order = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("at"))
    firsts = cells.where("copies > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(order).alias("_first"))
    on = cells["conv_id"].eqNullSafe(firsts["_conv"]) & (cells["digest"] == firsts["_digest"]) & cells["turn"].eqNullSafe(firsts["_first.at"])
    return cells.join(firsts, on, "left").select(*cells.columns, F.col("_digest").isNotNull().alias("first"))


_SEGMENT = (
    "conv_id long, part long, open boolean, lowest long, highest long, turns long, blank long, duplicate long, truncated long, illegal long, "
    "head string, tail string, costs array<long>, audits array<string>"
)
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("open", pa.bool_()), ("lowest", pa.int64()), ("highest", pa.int64()), ("turns", pa.int64())]
    + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")]
    + [("head", pa.string()), ("tail", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
_LEGAL = {"su", "ua", "au"}


class _Run:
    """What a partition gathers of one conversation: a character a turn, counts and the ends."""

    def __init__(self, conv_id, part: int):
        self.conv_id, self.part, self.codes = conv_id, part, []
        self.lowest = self.highest = 0  # they count only where turns does
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.head = self.tail = ""

    def add(self, at: int | None, initial: str, code: str, copies: int, first: bool) -> None:
        if not copies:
            return
        if at is not None and (at != self.highest or not self.turns):
            self.lowest, self.highest, self.turns = self.lowest if self.turns else at, at, self.turns + 1
        self.illegal += (copies - 1) + (self.tail != "" and self.tail + initial not in _LEGAL)  # equal neighbours are never legal
        self.head, self.tail = self.head or initial, initial
        again = copies - first
        if code == "x":
            self.blank += copies
        else:
            self.duplicate += again
            self.truncated += first and (code == "=" or code.isupper())
        if first:
            self.codes.append(code)
        self.codes.append("x" * again)

    def row(self, is_open: bool) -> dict:
        matrix = product("".join(self.codes))
        if not is_open:
            matrix = (cheapest(matrix),)
        return {
            "conv_id": self.conv_id, "part": self.part, "open": is_open, "lowest": self.lowest, "highest": self.highest, "turns": self.turns, "blank": self.blank,
            "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "head": self.head, "tail": self.tail,
            "costs": [e and e[0] for e in matrix], "audits": [e and e[1] for e in matrix],
        }


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted partition; the first and the last may go on in a neighbour and stay open."""
    run, opens, out = None, True, []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "initial", "code", "copies", "first"))
        for conv_id, part, at, initial, code, copies, first in zip(*columns, strict=True):
            if run is None:
                run = _Run(conv_id, part)
            elif run.conv_id != conv_id:
                out.append(run.row(opens))
                run, opens = _Run(conv_id, part), False
            run.add(at, initial, code, copies, bool(first))
        if len(out) > 5000:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out = []
    if run is not None:
        out.append(run.row(True))
    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _elements(row) -> Matrix:
    return tuple(None if a is None else (int(c), a) for c, a in zip(row.costs, row.audits, strict=True))


def _joined(last: bool):
    """Multiplies neighbouring segments of one conversation, FAN of them at most."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group.sort_values("part").itertuples(index=False))
        left = rows[0]._asdict()
        matrix = _elements(rows[0])
        for r in rows[1:]:
            matrix = times(matrix, _elements(r))
            for n in ("blank", "duplicate", "truncated", "illegal"):
                left[n] += getattr(r, n)
            left["illegal"] += bool(left["tail"] and r.head and left["tail"] + r.head not in _LEGAL)
            left["head"], left["tail"] = left["head"] or r.head, r.tail or left["tail"]
            if r.turns:
                left["lowest"] = left["lowest"] if left["turns"] else r.lowest
                left["turns"] += r.turns - (left["turns"] > 0 and left["highest"] == r.lowest)
                left["highest"] = r.highest
        if last:
            matrix = (cheapest(matrix),)
        left["open"], left["costs"], left["audits"] = not last, [e and e[0] for e in matrix], [e and e[1] for e in matrix]
        return pd.DataFrame([left]).astype({"conv_id": "Int64"})

    return join


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of ``turns`` (see :func:`repair`)."""
    parts = fine_grained(turns)
    order = ["conv_id", "turn", "role", "digest"]
    cells = _cells(turns).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marked = cells.select("conv_id", F.spark_partition_id().cast("long").alias("part"), "turn", "initial", "code", "copies", "first")
    segments = staged(marked.mapInArrow(_segments, _SEGMENT), "segments")
    # Two rows a partition at most; FAN neighbours at a time, until the width of all partitions is one group.
    tail = "conv_id long, " + _SEGMENT.split(", ", 1)[1]
    crossing, width = segments.where("open"), 1
    while True:
        width *= FAN
        crossing = crossing.groupBy("conv_id", F.floor(F.col("part") / width).alias("near")).applyInPandas(_joined(width >= parts), tail)
        if width >= parts:
            break
    span = F.try_add(F.try_subtract("highest", "lowest"), 1 - F.col("turns"))
    return segments.where("not open").unionByName(crossing).select(
        "conv_id", F.when(F.col("turns") == 0, F.lit(0)).otherwise(F.coalesce(span, F.lit(MOST))).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", F.get("costs", F.lit(0)).alias("cost"), F.get("audits", F.lit(0)).alias("audit"),
    )


# ---- texts and audits in one ordered pass

_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, position long, turn long, role string, text string, edit string"
_NEXT = {"s": "user", "u": "assistant", "a": "user", "": "user"}
_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Applies audits to the turns that follow them: (conv_id, None) opens a conversation, (conv_id, (turn, role, text, edit)) is a turn of it.

    A deleted turn has no text. Only the audit and the state are held, however long a conversation is.
    """
    facts, audit, at, state = None, "", 0, ""

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == INSERT:
            role = _NEXT[state]
            at, state = at + 1, role[0]
            yield facts, (None, role, "", INSERT)

    for row in rows:
        if row[0] is not None:  # facts of the next conversation
            if facts is not None:
                yield from inserted()
                yield facts, None
            facts, audit, at, state = row[0], row[0][-1], 0, ""
            continue
        turn_, role, text, copies = row[1:]
        for _ in range(copies):
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == REROLE:
                role = _NEXT[state]
            if edit == DELETE:
                yield facts, (turn_, role, None, DELETE)
            else:
                state = role[:1]
                yield facts, (turn_, role, text, edit)
    if facts is not None:
        yield from inserted()
        yield facts, None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        names = ("conv_id", "kind", "turn", "role", "text", "copies", *_FACTS, "audit")
        for conv_id, kind, at, role, text, copies, *facts in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            yield ((conv_id, *facts),) if kind == 0 else (None, at, role, text, copies)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *_FACTS, "audit", "repaired_sha256"]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
    out, digest, between = [], hashlib.sha256(), b""
    for facts, turn_ in _edited(_rows(batches)):
        if turn_ is None:
            out.append(dict(zip(names, (*facts, digest.hexdigest()), strict=True)))
            digest, between = hashlib.sha256(), b""
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        elif turn_[3] != DELETE:
            digest.update(between + f"{turn_[1]}:{turn_[2]}".encode("utf-8", "surrogatepass"))
            between = b"\n"
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    out, position, held = [], 0, 0
    for facts, turn_ in _edited(_rows(batches)):
        if turn_ is None:
            position = 0
        elif turn_[3] != DELETE:
            out.append(dict(zip(schema.names, (facts[0], position, *turn_), strict=True)))
            position, held = position + 1, held + len(turn_[2])
            if held > 4 << 20 or len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, held = [], 0
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _pass(turns: DataFrame, known: DataFrame) -> DataFrame:
    """Facts, then turns of each conversation, in order; a conversation's rows are one stream, as its digest is."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    copies = F.coalesce("copies", F.lit(1)) if "copies" in turns.columns else F.lit(1)
    empty = lambda kind: F.lit(None).cast(kind)
    texts = turns.where(copies > 0).select(
        "conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), role.alias("role"), _digest(role, text).alias("digest"), text.alias("text"), copies.cast("long").alias("copies"),
        *(empty("long").alias(n) for n in _FACTS), empty("string").alias("audit"),
    )
    facts = known.select(
        "conv_id", F.lit(0).alias("kind"), *(empty(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"), ("copies", "long"))),
        *_FACTS, "audit",
    )
    order = ["conv_id", "kind", "turn", "role", "digest"]
    return texts.unionByName(facts).repartition(fine_grained(turns), "conv_id").sortWithinPartitions(*order).drop("digest")


def _whole(turns: DataFrame) -> DataFrame:
    return turns.withColumn("conv_id", F.col("conv_id").cast("long"))


def report(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text, and ``copies`` if rows stand for several or none).

    gaps: turns lacking between the lowest and the highest; blank, duplicate, truncated: turns by their first fault (no text, role and text seen
    earlier, last character no end of a sentence); illegal: neighbours that can't follow each other; cost and audit: the cheapest edits,
    the least audit among equals; repaired_sha256: digest of the repaired ``role:text`` lines.

    Nulls: a null role or text is one space, a null turn comes first and makes no gap, a null conv_id is one more conversation. Ties in a turn:
    by role, then by the digest of role and text; equal rows are duplicates. A role with another initial can't be kept; an empty role neither. Empty table: no rows.
    Very long conversations spread over partitions up to the digest, which one task streams; very long texts are held one at a time with their batch. A span of
    turns beyond a long is the largest long. Other columns are ignored.
    """
    turns = _whole(turns)
    known = staged(audits(turns), "audits")
    return _pass(turns, known).mapInArrow(_reports, _REPORT)


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, turn (null for an inserted one), role, text and edit (K kept, R with another role, I inserted)."""
    turns = _whole(turns)
    known = staged(audits(turns), "audits")
    fixed = staged(_pass(turns, known).mapInArrow(_turns, _TURNS), "repaired")
    release(known)
    return fixed
