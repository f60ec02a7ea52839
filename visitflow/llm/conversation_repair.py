"""Repair of the structure of conversations by a streamed dynamic program.

Rows are partitioned by conversation and sorted by turn; a task carries the program's state from batch to batch, so a
conversation of any length needs the memory of one row and of its edit string. The roles' initials have to become
``(s?(ua)+)?``, which four states recognise. For each state the program holds the cheapest edits so far, the least in ASCII order
among equals, and the hash of the text that they give. Costs count from the smallest, so only few different
situations exist; each is worked out once, and a row's backpointers are the two-byte number of its step. Long conversations
write them to an unnamed scratch file of the task, which is gone with the task; a lost task starts its partition anew.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitflow.llm.common import bounded_batches

#: Steps that a conversation holds in memory before it writes them to the task's scratch file.
STEPS_IN_MEMORY = 1 << 20
#: Conversations in a batch of results, and characters of their edits.
REPORTS_AT_ONCE, EDITS_AT_ONCE = 1_000, 1 << 22

#: States: nothing yet, behind the system's row, behind a user's, behind an assistant's. The last row must leave the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a user's or assistant's row leads that is inserted or has its role set, and the initial that it has.
ONWARD = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Fixed costs of the edits.
RESET, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAULTLESS, BLANK, DUPLICATE, CUT = range(4)
LEGAL = {"su", "ua", "au"}


def kept_state(state: int, initial: str) -> int | None:
    """The state behind a row that is kept as it is, or None where it may not stand."""
    if state == START and initial == "s":
        return SYSTEM
    return ONWARD[state] if initial == ROLE[ONWARD[state]][0] else None


#: Cheapest edits up to a state: cost above the smallest, and place in the ASCII order of all states' edits.
Held = tuple[int, int] | None
Situation = tuple[Held, Held, Held, Held]
BEGINNING: Situation = ((0, 0), None, None, None)


class Way(NamedTuple):
    """How a state is reached: from which state, by how many inserted rows, and by which edit of the row."""

    origin: int
    inserted: int
    edit: str


class Step(NamedTuple):
    after: Situation
    cost: int
    ways: tuple[Way | None, Way | None, Way | None, Way | None]


def with_inserts(held: Situation) -> dict[int, tuple[int, int, int, int]]:
    """``(cost, order, origin, inserted)`` of each state once rows may be inserted.

    Edits of two origins differ before the end of either, so their order is that of the origins.
    """
    best: dict[int, tuple[int, int, int, int]] = {}
    for origin, entry in enumerate(held):
        if entry is None:
            continue
        state = origin
        for inserted in range(3):
            found = (entry[0] + INSERT * inserted, entry[1], origin, inserted)
            best[state] = min(best.get(state, found), found)
            state = ONWARD[state]
    return best


def work_out(held: Situation, initial: str, fault: int) -> Step:
    """The step of one row, whatever came before: cheapest edits to each state, the ASCII-least of equals."""
    found: dict[int, list[tuple[int, tuple[int, str], Way]]] = {}
    for state, (cost, order, origin, inserted) in with_inserts(held).items():
        edits = [("D", state, DELETE)]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            kept = kept_state(state, initial)
            if kept is not None:
                edits.append(("K", kept, more))
            edits.append(("R", ONWARD[state], RESET + more))
        for edit, to, price in edits:
            found.setdefault(to, []).append((cost + price, (order, "I" * inserted + edit), Way(origin, inserted, edit)))
    best = {state: min(entries) for state, entries in found.items()}
    # Behind an assistant's row all that an earlier state allows is allowed too, so dearer ones of those lead nowhere.
    behind = min((best[s][0] + INSERT * (s == USER) for s in (USER, ASSISTANT) if s in best), default=None)
    if behind is not None:
        best = {s: b for s, b in best.items() if b[0] <= behind + {START: DELETE, SYSTEM: 0}.get(s, b[0])}
    least = min(b[0] for b in best.values())
    order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1]))}
    return Step(
        tuple((best[s][0] - least, order[s]) if s in best else None for s in range(4)),
        least,
        tuple(best[s][2] if s in best else None for s in range(4)),
    )


class Steps:
    """All steps met by a task, by number; there are few, since situations repeat."""

    def __init__(self) -> None:
        self.all: list[Step] = []
        self._number: dict[tuple[Situation, str, int], int] = {}

    def number(self, held: Situation, initial: str, fault: int) -> int:
        key = (held, initial if initial in ("s", "u", "a") else "", fault if fault == CUT else min(fault, 1))
        if key not in self._number:
            self._number[key] = len(self.all)
            self.all.append(work_out(held, initial, fault))
        return self._number[key]


class Text:
    """Hash of the rows so far; copied before it grows, so states may share it."""

    def __init__(self, digest=None, some: bool = False):
        self._digest, self._some = digest or hashlib.sha256(), some

    def with_rows(self, rows: list[bytes]) -> Text:
        if not rows:
            return self
        digest = self._digest.copy()
        digest.update((b"\n" if self._some else b"") + b"\n".join(rows))
        return Text(digest, True)

    def hexdigest(self) -> str:
        return self._digest.hexdigest()


class Conversation:
    """One conversation in the course of being read."""

    def __init__(self, steps: Steps):
        self._steps = steps
        self._held, self._cost = BEGINNING, 0
        self._texts: list[Text | None] = [Text(), None, None, None]
        self._back, self._scratch, self._written = array("H"), None, 0
        self._initial: str | None = None
        self._turns = [0, 0, 0]  # smallest, largest, number of different ones
        self.counts = {BLANK: 0, DUPLICATE: 0, CUT: 0}
        self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            least, last, different = self._turns
            self._turns = [turn, turn, 1] if not different else [least, turn, different + (turn != last)]
        initial = role[:1]
        self.illegal += self._initial is not None and self._initial + initial not in LEGAL
        self._initial = initial
        if fault:
            self.counts[fault] += 1
        number = self._steps.number(self._held, initial, fault)
        step = self._steps.all[number]
        body = b":" + text.encode()
        self._texts = [way and self._follow(way, state, role, body) for state, way in enumerate(step.ways)]
        self._held, self._cost = step.after, self._cost + step.cost
        self._back.append(number)
        if len(self._back) >= STEPS_IN_MEMORY:
            self._scratch = self._scratch or tempfile.TemporaryFile()
            self._back.tofile(self._scratch)
            self._written += len(self._back)
            self._back = array("H")

    def _follow(self, way: Way, state: int, role: str, body: bytes) -> Text:
        rows = inserted_rows(way.origin, way.inserted)
        if way.edit != "D":
            rows.append((role if way.edit == "K" else ROLE[state]).encode() + body)
        return self._texts[way.origin].with_rows(rows)

    @property
    def gaps(self) -> int:
        least, last, different = self._turns
        return last - least + 1 - different if different else 0

    def finish(self) -> tuple[int, str, str]:
        """Cost, edits and hash of the repaired rows."""
        ends = with_inserts(self._held)
        cost, _, origin, inserted = min(ends[s] for s in (START, ASSISTANT) if s in ends)
        text = self._texts[origin].with_rows(inserted_rows(origin, inserted))
        edits = bytearray(b"I" * inserted)  # last first
        state = origin
        for numbers in self._back_blocks():
            for number in reversed(numbers):
                way = self._steps.all[number].ways[state]
                edits += way.edit.encode() + b"I" * way.inserted
                state = way.origin
        if self._scratch:
            self._scratch.close()
        edits.reverse()
        return self._cost + cost, edits.decode(), text.hexdigest()

    def _back_blocks(self) -> Iterator[array]:
        yield self._back
        for end in range(self._written, 0, -STEPS_IN_MEMORY):
            self._scratch.seek((end - STEPS_IN_MEMORY) * array("H").itemsize)
            block = array("H")
            block.fromfile(self._scratch, STEPS_IN_MEMORY)
            yield block


def inserted_rows(state: int, n: int) -> list[bytes]:
    rows = []
    for _ in range(n):
        state = ONWARD[state]
        rows.append(ROLE[state].encode() + b":")
    return rows


def fault_of(text: Column, repeated: Column) -> Column:
    """The first fault of a row by number, as :data:`BLANK`, :data:`DUPLICATE`, :data:`CUT`; 0 for none."""
    return (
        F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(repeated, DUPLICATE)
        .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT)
        .otherwise(FAULTLESS)
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, lost)``: rows damaged by the checksum of conversation and turn; a null counts as one blank.

    Of 20 checksums 0 loses the row, 1 empties its text, 2 takes its ends of sentences, 3 repeats it, 4 makes it a user's.
    """
    blank = F.lit(" ")
    sign = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]).cast("binary"))
    kind = (sign % 20).cast("int")
    text, role = (F.coalesce(F.col(c).cast("string"), blank) for c in ("text", "role"))
    shaped = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return shaped.drop("copy")


def _with_faults(rows: DataFrame, lost: str | None) -> DataFrame:
    """The columns that count, each row's fault, and whether a row before it says the same."""
    gone = F.col(lost) if lost else F.lit(False)
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        F.coalesce(gone, F.lit(False)).alias("lost"),
    )
    bare = [F.when(F.col("lost"), F.lit("")).otherwise(F.col(c)).alias(c) for c in ("role", "text")]
    same = Window.partitionBy("conv_id", "role", "text", "lost").orderBy(F.asc_nulls_first("turn"))
    counted = plain.select("conv_id", "turn", *bare, "lost").withColumn("repeated", F.row_number().over(same) > 1)
    return counted.withColumn("fault", fault_of(F.col("text"), F.col("repeated")))


def _sorted_by_conversation(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation's rows in one partition, in the order of turns; ties by role, text, and first occurrences."""
    order = [F.asc_nulls_first(c) for c in ("conv_id", *first, "turn", "role", "text", "repeated")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


REPORT = (
    "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def repair_reports(rows: DataFrame, lost: str | None = None) -> DataFrame:
    """One row for each conversation: its faults, the cheapest edits that repair it, and the hash of the repaired rows.

    ``rows`` has ``conv_id, turn, role, text``, other columns are ignored; rows where the boolean column ``lost`` is true only name
    their conversation. Null turns come first, a null role or text is one blank, and the null ``conv_id`` is a conversation like others. Rows of one turn
    are ordered by role and text. A conversation without rows has zeros, no edits and the hash of nothing; an empty
    table gives an empty result. Memory: a batch of rows, and a byte for each edit of the conversation at hand.
    """
    bounded_batches(rows.sparkSession)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = Steps()
        columns = [field.split()[0] for field in REPORT.split(", ")]
        reports: list[tuple] = []
        at: tuple[str | None, Conversation] | None = None

        def report() -> tuple:
            name, conversation = at
            counts = [conversation.counts[f] for f in (BLANK, DUPLICATE, CUT)]
            return (name, conversation.gaps, *counts, conversation.illegal, *conversation.finish())

        for batch in batches:
            for name, turn, role, text, lost, fault in zip(*(batch[c].tolist() for c in given), strict=True):
                if at is None or at[0] != name:
                    if at:
                        reports.append(report())
                    at = (name, Conversation(steps))
                if not lost:
                    at[1].add(None if turn is None else int(turn), role, text, fault)
                if len(reports) >= REPORTS_AT_ONCE or sum(len(r[-2]) for r in reports[-1:]) > EDITS_AT_ONCE:
                    yield pd.DataFrame(reports, columns=columns)
                    reports = []
        if at:
            yield pd.DataFrame([*reports, report()], columns=columns)

    given = ["conv_id", "turn", "role", "text", "lost", "fault"]
    # Numbers that may be null travel as texts: pandas would make them floating point.
    texts = [F.col(c).cast("string").alias(c) for c in ("conv_id", "turn")]
    found = _sorted_by_conversation(_with_faults(rows, lost)).select(*texts, *given[2:]).mapInPandas(stream, REPORT)
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))


def repaired_turns(rows: DataFrame, reports: DataFrame, lost: str | None = None) -> DataFrame:
    """``(conv_id, position, turn, role, text, edit)``: the rows of repaired conversations, in order of position from 0.

    A report goes ahead of its conversation's rows, and the rows are streamed as its edits say. Inserted rows have no turn.
    """
    bounded_batches(rows.sparkSession)
    ordered = _with_faults(rows, lost).where(~F.col("lost")).withColumn("audit", F.lit(None).cast("string"))
    heads = reports.select("conv_id", "audit")
    schema = "conv_id string, position long, turn string, role string, text string, edit string"

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edits, at, state, position, name = "", 0, START, 0, None

        def inserts(out: list[tuple]) -> None:
            nonlocal at, state, position
            while edits[at : at + 1] == "I":
                state, at = ONWARD[state], at + 1
                out.append((name, position, None, ROLE[state], "", "I"))
                position += 1

        for batch in batches:
            out: list[tuple] = []
            for conv, turn, role, text, audit in zip(*(batch[c].tolist() for c in given), strict=True):
                if audit is not None:
                    edits, at, state, position, name = audit, 0, START, 0, conv
                    inserts(out)
                    continue
                edit, at = edits[at], at + 1
                if edit != "D":
                    state = kept_state(state, role[:1]) if edit == "K" else ONWARD[state]
                    out.append((name, position, turn, role if edit == "K" else ROLE[state], text, edit))
                    position += 1
                inserts(out)
            yield pd.DataFrame(out, columns=["conv_id", "position", "turn", "role", "text", "edit"])

    given = ["conv_id", "turn", "role", "text", "audit"]
    head = F.col("audit").isNull()  # false comes first
    both = ordered.unionByName(heads, allowMissingColumns=True).withColumn("is_row", head)
    texts = [F.col(c).cast("string").alias(c) for c in ("conv_id", "turn")]
    found = _sorted_by_conversation(both, "is_row").select(*texts, *given[2:]).mapInPandas(stream, schema)
    return found.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})
