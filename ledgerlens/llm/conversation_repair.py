"""Cheapest repair of conversations to ``(system? (user assistant)+)?``, by a streaming dynamic programme.

Rows are partitioned by conversation and sorted by turn within partitions; one pass over each partition's Arrow batches
carries the programme's state from batch to batch: for each grammar state the least cost so far, the rank of its edit
string among the states (ties go to the ASCII-least string), and one byte of backpointer a row and state. At the end of
a conversation the backpointers are followed from the best final state. A conversation above ``block_rows`` rows spills:
its rows and its backpointers leave the task as table rows, in blocks, on shared storage, so that a task holds one block
of one conversation only. Further passes over the spilled blocks then follow the backpointers from the last block to
the first and put the repaired text together from the first to the last.

Faults (first that counts): ``blank`` (only white space ``[\\x20\\x09-\\x0D]``), ``duplicate`` (role and text of an
earlier row), ``truncated`` (the last other character is not ``.``, ``!`` or ``?``). Edits: Keep costs 0, Rerole to user
or assistant 2, Delete 3 (the only one for blank and duplicate rows), Insert an empty user or assistant row 2; a truncated
row that stays adds 1.

Cases: rows of a NULL ``conv_id`` are one conversation; NULL turns come first; rows of one turn are taken by role and
text, so that repeated rows stand together; a NULL role or text counts as one space; a role whose first character is
not s, u or a (or an empty role) fits no place; a conversation whose rows are all marked ``dropped`` has zeros, an empty
audit and the hash of the empty string; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import ship_package
from .common import ASCII_SPACE, stored

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a conversation that a task holds; longer conversations spill.
BLOCK_ROWS = 65_536
#: Bytes of text of a conversation that a task holds.
BLOCK_BYTES = 16 << 20

#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant row where one may stand, by the state before; and its role.
_NEXT = [USER, USER, ASSISTANT, USER]
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Edits of a row, with a row inserted before it or not, in ASCII order of their letters.
_EDITS = ["D", "IK", "IR", "K", "R"]
_END = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
_NONE = 1 << 62


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by a checksum of ``conv_id:turn``: rows dropped (marked so), texts emptied or
    without sentence ends, rows repeated, roles set to user. NULLs are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    return (conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"), (F.col("kind") == 0).alias("dropped"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
            .drop("copy"))


def _initial_state(initial: str, state: int) -> int | None:
    """State after keeping a row of this initial, None where it does not fit."""
    if state == START and initial == "s":
        return SYSTEM
    return _NEXT[state] if initial == ("a" if _NEXT[state] == ASSISTANT else "u") else None


def _step(cost: list[int], rank: list[int], initial: str, fault: str | None) -> tuple[list[int], list[int], bytes]:
    """Costs and ranks of the four states after a row, and a byte for each: edit times 4 plus the state before."""
    best: list[tuple | None] = [None] * 4
    removed = fault in ("blank", "duplicate")
    stays = TRUNCATED if fault == "truncated" else 0
    for state in range(4):
        if cost[state] >= _NONE:
            continue
        ways = [(DELETE, 0, state)]
        if not removed:
            inserted = _NEXT[state]
            ways.append((INSERT + REROLE + stays, 2, _NEXT[inserted]))
            ways.append((REROLE + stays, 4, _NEXT[state]))
            if (to := _initial_state(initial, state)) is not None:
                ways.append((stays, 3, to))
            if (to := _initial_state(initial, inserted)) is not None:
                ways.append((INSERT + stays, 1, to))
        for more, edit, to in ways:
            way = (cost[state] + more, rank[state], edit, state)
            if best[to] is None or way < best[to]:
                best[to] = way
    # two strings of different states over the same rows are never equal, nor is one the beginning of the other
    order = sorted((b[1], b[2], to) for to, b in enumerate(best) if b)
    ranks = [0] * 4
    for r, (_, _, to) in enumerate(order):
        ranks[to] = r
    return [b[0] if b else _NONE for b in best], ranks, bytes((b[2] * 4 + b[3] if b else 255) for b in best)


def _finish(cost: list[int], rank: list[int]) -> tuple[int, int]:
    """Final state and its whole cost, with the rows that must follow."""
    ends = [(cost[s] + INSERT * len(_END[s]), rank[s], s) for s in range(4) if cost[s] < _NONE]
    whole, _, state = min(ends)
    return state, whole


def _trace(back: bytes, state: int) -> tuple[list[str], int]:
    """Edits of the rows of a block that ends in ``state``, and the state before it."""
    edits = []
    for at in range(len(back) - 4, -1, -4):
        b = back[at + state]
        edits.append(_EDITS[b >> 2])
        state = b & 3
    return edits[::-1], state


class _Repaired:
    """The repaired rows of a conversation, one after the other."""

    def __init__(self):
        self.state, self.hash, self.first, self.audit = START, hashlib.sha256(), True, []

    def _row(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + f"{role}:{text}").encode())
        self.first = False

    def add(self, edit: str, role: str, text: str) -> None:
        """A row's edit: ``D``, ``K``, ``R``, or ``I`` and one of the latter two."""
        self.audit.append(edit)
        for letter in edit:
            if letter == "D":
                continue
            to = _initial_state(role[:1], self.state) if letter == "K" else _NEXT[self.state]
            self._row(role if letter == "K" else _ROLE[to], "" if letter == "I" else text)
            self.state = to

    def end(self) -> tuple[str, str]:
        """Audit and hash, with the rows inserted at the end."""
        for _ in _END[self.state]:
            self.add("I", "", "")
        return "".join(self.audit), self.hash.hexdigest()


class _Conversation:
    """State of the conversation that a task is at."""

    def __init__(self, conv_id):
        self.conv_id, self.block, self.rows, self.back, self.bytes = conv_id, 0, [], bytearray(), 0
        self.cost, self.rank = [0, _NONE, _NONE, _NONE], [0, 0, 0, 0]
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial = 0, None
        self.least = self.greatest = self.turn = None
        self.turns = 0

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.greatest = self.turn = turn
            self.turns += 1
        if fault:
            self.counts[fault] += 1
        self.cost, self.rank, back = _step(self.cost, self.rank, initial, fault)
        self.back += back
        self.rows.append((role, text))
        self.bytes += len(text) + len(role)

    def numbers(self) -> dict:
        gaps = 0 if self.least is None else self.greatest - self.least + 1 - self.turns
        state, cost = _finish(self.cost, self.rank)
        return {"gaps": gaps, **self.counts, "illegal": self.illegal, "cost": cost, "state": state}

    def spill(self) -> list[dict]:
        """The rows and backpointers held, as table rows."""
        out = [{"kind": "row", "block": self.block, "place": i, "role": r, "text": t} for i, (r, t) in enumerate(self.rows)]
        out.append({"kind": "back", "block": self.block, "back": bytes(self.back)})
        self.block, self.rows, self.back, self.bytes = self.block + 1, [], bytearray(), 0
        return [{"conv_id": self.conv_id, **x} for x in out]

    def close(self) -> list[dict]:
        """The result row, or the rest of a spilled conversation and its numbers."""
        numbers = self.numbers()
        if self.block:
            return self.spill() + [{"conv_id": self.conv_id, "kind": "end", "block": self.block, **numbers}]
        repaired = _Repaired()
        edits, _ = _trace(bytes(self.back), numbers["state"])
        for edit, (role, text) in zip(edits, self.rows):
            repaired.add(edit, role, text)
        audit, digest = repaired.end()
        return [{"conv_id": self.conv_id, "kind": "done", **numbers, "audit": audit, "repaired_sha256": digest}]


_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SCHEMA = ("conv_id long, kind string, block long, place long, role string, text string, back binary, "
           + ", ".join(f"{n} long" for n in _NUMBERS) + ", state int, audit string, repaired_sha256 string")
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _frames(rows: list[dict]) -> Iterator[pd.DataFrame]:
    if rows:
        out = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
        rows.clear()
        yield out


def _none(x):
    return None if x is None or x is pd.NaT or x != x else x


def forward(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One pass over ``rows`` (conv_id, turn, role, text, fault, dropped) sorted by conversation and turn in their
    partitions: ``done`` rows, and for conversations that spill ``row``, ``back`` and ``end`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Conversation | None = None
        out: list[dict] = []
        for pdf in batches:
            for conv_id, turn, role, text, fault, dropped in zip(*(pdf[c].tolist() for c in _INPUT)):
                conv_id = _none(conv_id)
                if now is None or conv_id != now.conv_id:
                    out += now.close() if now else []
                    now = _Conversation(conv_id)
                if not dropped:
                    turn = _none(turn)
                    now.add(None if turn is None else int(turn), role, text, _none(fault))
                    if len(now.rows) >= block_rows or now.bytes >= block_bytes:
                        out += now.spill()
                        yield from _frames(out)
            yield from _frames(out)
        out += now.close() if now else []
        yield from _frames(out)

    # decimals keep whole numbers whole next to NULLs
    keyed = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"),
                        "role", "text", "fault", "dropped")
    return keyed.mapInPandas(run, _SCHEMA.replace("conv_id long", "conv_id string"))


_INPUT = ["conv_id", "turn", "role", "text", "fault", "dropped"]


def _backward(spilled: DataFrame) -> DataFrame:
    """(conv_id, block, edits) of spilled conversations: their blocks from the last to the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            out = []
            for conv_id, block, kind, back, end in zip(pdf["conv_id"], pdf["block"], pdf["kind"], pdf["back"], pdf["state"]):
                if kind == "end":
                    state = int(end)
                    continue
                edits, state = _trace(bytes(back), state)
                out.append((conv_id, block, ",".join(edits)))
            yield pd.DataFrame(out, columns=["conv_id", "block", "edits"])

    blocks = spilled.where("kind <> 'row'").select("conv_id", "block", "kind", "back", "state")
    return (blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
            .mapInPandas(run, "conv_id string, block long, edits string"))


def _assemble(spilled: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of spilled conversations: each block's edits, then its rows, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, repaired, held = object(), None, []
        for pdf in batches:
            out = []
            for conv_id, place, role, text, own in zip(pdf["conv_id"], pdf["place"], pdf["role"], pdf["text"], pdf["edits"]):
                if conv_id != last:
                    if repaired:
                        out.append((last, *repaired.end()))
                    last, repaired = conv_id, _Repaired()
                if place < 0:
                    held = own.split(",")
                else:
                    repaired.add(held[int(place)], role, text)
            yield pd.DataFrame(out, columns=["conv_id", "audit", "repaired_sha256"])
        if repaired:
            yield pd.DataFrame([(last, *repaired.end())], columns=["conv_id", "audit", "repaired_sha256"])

    rows = spilled.where("kind = 'row'").select("conv_id", "block", "place", "role", "text", F.lit(None).cast("string").alias("edits"))
    heads = edits.select("conv_id", "block", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("text"), "edits").where("edits <> ''")
    return (rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "block", "place")
            .mapInPandas(run, "conv_id string, audit string, repaired_sha256 string"))


def with_faults(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, fault, dropped), partitioned by conversation; the first row of a role and text in
    its conversation is no duplicate."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in conversations.columns else F.lit(False)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                space("role").alias("role"), space("text").alias("text"), dropped.alias("dropped"))
    again = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"))
    left = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    fault = (F.when(F.length(left) == 0, "blank").when(F.col("again") > 1, "duplicate")
             .when(~F.right(left, F.lit(1)).isin(".", "!", "?"), "truncated"))
    return (rows.repartition("conv_id").withColumn("again", F.row_number().over(again))
            .select("conv_id", "turn", "role", "text", fault.alias("fault"), "dropped"))


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per ``conv_id``: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    ship_package(conversations.sparkSession)
    rows = with_faults(conversations).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    passed = stored(forward(rows, block_rows, block_bytes), "conversations")
    found = passed.where("kind = 'done'").select("conv_id", *_NUMBERS, "audit", "repaired_sha256")
    spilled = passed.where("kind <> 'done'")
    texts = _assemble(spilled, stored(_backward(spilled), "edits"))
    long = (spilled.where("kind = 'end'").select("conv_id", *_NUMBERS).join(
        texts.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"))
    return found.unionByName(long).select(F.col("conv_id").cast("long").alias("conv_id"), *_NUMBERS, "audit", "repaired_sha256")
