"""Conversation repair against exhaustive and backward searches of the edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from visitflow.llm import conversation_repair as repair
from visitflow.llm.conversation_repair import Conversation, Steps, damaged, repair_reports, repaired_turns
from visitflow.llm.queries import QUERIES

ROWS = "conv_id long, turn long, role string, text string"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def brute_faults(rows):
    """The first fault of each ``(turn, role, text)``, by letter; blank for none."""
    seen, out = set(), []
    for _, role, text in rows:
        ends = re.findall("[^\x20\x09-\x0d]", text)
        fault = "b" if not ends else "d" if (role, text) in seen else "t" if ends[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def brute_repair(rows):
    """Cost, edits and repaired rows, searched from the end backwards."""
    faults = brute_faults(rows)

    @lru_cache(None)
    def best(i, made, inserts):
        """Cheapest edits from row ``i`` on, behind the initials ``made`` (cut to what the pattern needs)."""
        found = [(0, "", ())] if i == len(rows) and re.fullmatch("(s?(ua)+)?", made) else []

        def onward(initial, at, n):
            text = made + initial
            text = text.replace("uaua", "ua")
            return best(at, text, n) if re.fullmatch("s?(ua)*u?", text) else None

        def add(cost, edit, line, rest):
            if rest:
                found.append((cost + rest[0], edit + rest[1], (*line, *rest[2])))

        if inserts < 4:
            for role in ("user", "assistant"):
                add(2, "I", [f"{role}:"], onward(role[0], i, inserts + 1))
        if i < len(rows):
            _, role, text = rows[i]
            add(3, "D", [], best(i + 1, made, 0))
            if faults[i] in ("", "t"):
                more = len(faults[i])
                add(more, "K", [f"{role}:{text}"], onward(role[:1], i + 1, 0) if role[:1] else None)
                for new in ("user", "assistant"):
                    add(2 + more, "R", [f"{new}:{text}"], onward(new[0], i + 1, 0))
        return min(found) if found else None

    for i in range(len(rows), 0, -20):  # from the end, so that the recursion stays shallow
        for made in ("", "s", "u", "su", "ua", "sua", "uau", "suau"):
            best(i, made, 0)
    return best(0, "", 0)


def exhaustive(rows):
    """Every string of edits up to a length, read as the pattern demands."""
    faults, best = brute_faults(rows), None
    for length in range(len(rows), 2 * len(rows) + 3):
        for edits in itertools.product("DIKR", repeat=length):
            if length - edits.count("I") != len(rows):
                continue
            cost, i, made = 0, 0, ""
            for edit in edits:
                due = "a" if made.endswith("u") else "u"
                if edit == "I":
                    cost, made = cost + 2, made + due
                    continue
                _, role, _ = rows[i]
                if edit == "D":
                    cost += 3
                elif faults[i] in ("b", "d"):
                    break
                else:
                    cost += (faults[i] == "t") + 2 * (edit == "R")
                    made += role[:1] or "?" if edit == "K" else due
                i += 1
            else:
                if re.fullmatch("(s?(ua)+)?", made):
                    found = (cost, "".join(edits))
                    best = min(best or found, found)
    return best


def streamed(rows):
    conversation, steps = Conversation(Steps()), brute_faults(rows)
    for (turn, role, text), fault in zip(rows, steps, strict=True):
        conversation.add(turn, role, text, ["", "b", "d", "t"].index(fault))
    return conversation.finish()


ROLES = ["user", "assistant", "system", "tool", "", " ", "unknown", "é", "User"]
TEXTS = ["Well.", "So?", "cut", "", " \t", "Yes! \n", "no.\x85", "ok", "one.", "two.", "three."]


def random_rows(draw, n):
    roles = ROLES[: draw.choice([2, 3, 9])]
    return [(k, draw.choice(roles), draw.choice(TEXTS) if draw.random() < 0.5 else f"text {draw.randrange(99)}.") for k in range(n)]


def digest(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(30))
def test_streamed_edits(seed, monkeypatch):
    monkeypatch.setattr(repair, "STEPS_IN_MEMORY", draw_size := 1 + seed % 7)
    draw = random.Random(seed)
    for n in [0, 1, 2, 3, 5, 8, 13, 40, draw_size * 3]:
        rows = random_rows(draw, n)
        cost, edits, lines = brute_repair(rows)
        assert streamed(rows) == (cost, edits, digest(lines))


@pytest.mark.parametrize("roles", ["", *map("".join, itertools.product("suax", repeat=3))])
def test_against_all_edits(roles):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(i, names[r], "done." if i != 1 else "cut") for i, r in enumerate(roles)]
    assert streamed(rows)[:2] == exhaustive(rows)


def test_situations_stay_few():
    steps, draw = Steps(), random.Random(5)
    conversation = Conversation(steps)
    for k in range(60_000):
        conversation.add(k, draw.choice(ROLES), f"{k}" + draw.choice([".", ""]), draw.choice([0, 0, 3, 1]))
    assert len(steps.all) < 3000
    deleted = Conversation(steps)
    for k in range(5_000):
        deleted.add(k, "user", "", 1)
    assert deleted.finish()[:2] == (15_000, "D" * 5_000)
    assert len(steps.all) < 3100


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        held = out.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: sorted(held, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for conv, held in out.items()}


def brute_report(conv, rows):
    faults = brute_faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, edits, lines = brute_repair(rows)
    return (conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, edits, digest(lines))


def rows_of(frame):
    return sorted(map(tuple, frame.select("conv_id", *COUNTS, "audit", "repaired_sha256").collect()), key=repr)


def odd_rows(seed, n=400):
    draw = random.Random(seed)
    ids = [None, 2**60 + 1, 0, -5, *range(1, 40)]
    rows = [
        (draw.choice(ids), draw.choice([None, 2**60, *range(12)]), draw.choice([None, *ROLES]), draw.choice([None, *TEXTS, f"more {i}."]))
        for i in range(n)
    ]
    return rows + rows[:30]


@pytest.mark.parametrize("seed", range(2))
def test_odd_rows(spark, seed, monkeypatch):
    monkeypatch.setattr(repair, "REPORTS_AT_ONCE", 3)
    rows = odd_rows(seed)
    frame = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("lost", "fault", "repeated", "audit", "copy", "kind")}).repartition(4)
    expected = sorted((brute_report(conv, held) for conv, held in brute_damage(rows).items()), key=repr)
    assert rows_of(repair_reports(damaged(frame), lost="lost")) == expected
    assert any(r[0] is None for r in expected)


def test_plain_rows_with_clashing_columns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, None, None, None)]
    frame = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("lost", "audit", "is_row")})
    first = [(None, " ", " "), (0, "user", "Hi."), (1, "user", "Again.")]
    assert rows_of(repair_reports(frame)) == [brute_report(1, first)]
    assert [r["text"] for r in repaired_turns(frame, repair_reports(frame)).orderBy("position").collect()] == ["Hi.", "Again."]


def test_repaired_turns(spark):
    rows = odd_rows(7)
    frame = damaged(spark.createDataFrame(rows, ROWS))
    reports = repair_reports(frame, "lost")
    lines = {}
    for r in sorted(repaired_turns(frame, reports, "lost").collect(), key=lambda r: (repr(r["conv_id"]), r["position"])):
        assert r["position"] == len(lines.setdefault(r["conv_id"], []))
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in reports.collect():
        assert digest(lines.get(r["conv_id"], [])) == r["repaired_sha256"]


def test_long_conversation_over_batches(spark, monkeypatch):
    """One conversation of many batches, most of all rows; backpointers go through the scratch file."""
    monkeypatch.setattr(repair, "STEPS_IN_MEMORY", 100)
    draw = random.Random(3)
    rows = [(1, k, draw.choice(["user", "assistant"]), f"row {k}" + draw.choice([".", ""])) for k in range(900)]
    rows += [(k, 0, "user", "Hello.") for k in range(2, 40)]
    expected = sorted((brute_report(conv, held) for conv, held in brute_damage(rows).items()), key=repr)
    assert rows_of(repair_reports(damaged(spark.createDataFrame(rows, ROWS)), "lost")) == expected


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert repair_reports(damaged(none), "lost").collect() == []
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    found = rows_of(repair_reports(damaged(spark.createDataFrame([(lost, 0, "user", "Gone.")], ROWS)), "lost"))
    assert found == [(lost, 0, 0, 0, 0, 0, 0, "", digest([]))]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = sorted((brute_report(conv, held) for conv, held in brute_damage(rows).items()), key=repr)
    assert rows_of(QUERIES["op12_conversation_repair"](spark, sf)) == expected
