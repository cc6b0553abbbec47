"""Conversation repair against every sequence of edits, and against a plain dynamic program on long and damaged conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from assayframe.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, part long, code string, digest long, first string"
FORM = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\v\f\r"


def faults(rows):
    """First fault of each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        last = text.strip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_sequence(rows):
    """The least (cost, audit, repaired) over all edits with up to two inserts in each gap."""
    found, marks = None, faults(rows)
    inserts = lambda: [list(p) for n in range(3) for p in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*(["D"] if m in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for m in marks)):
        for gaps in itertools.product(inserts(), repeat=len(rows) + 1):
            roles, audit, cost, text = "", "", 0, []
            for i, own in enumerate(gaps):
                for r in own:
                    roles, audit, cost = roles + r, audit + "I", cost + 2
                    text.append(({"u": "user", "a": "assistant"}[r], ""))
                if i < len(rows):
                    e, (_, role, t) = edits[i], rows[i]
                    audit += e[0]
                    if e == "D":
                        cost += 3
                        continue
                    role = role if e == "K" else {"u": "user", "a": "assistant"}[e[1]]
                    cost += (0 if e == "K" else 2) + (marks[i] == "truncated")
                    roles += role[:1] or "?"
                    text.append((role, t))
            if FORM.fullmatch(roles) and (found is None or (cost, audit) < found[:2]):
                found = (cost, audit, text)
    return found


def program(rows):
    """The same by states, turn by turn."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ())}

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserting(table):
        for _ in range(3):
            for state, (c, a, t) in list(table.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in step:
                        better(table, step[state, role[0]], (c + 2, a + "I", t + ((role, ""),)))
        return table

    best = inserting(best)
    for (_, role, text), mark in zip(rows, faults(rows), strict=True):
        after = {}
        for state, (c, a, t) in best.items():
            better(after, state, (c + 3, a + "D", t))
            if mark not in ("blank", "duplicate"):
                more = mark == "truncated"
                for new, cost, edit in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    if (state, new[:1]) in step:
                        better(after, step[state, new[:1]], (c + cost + more, a + edit, t + ((new, text),)))
        best = inserting(after)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows, solve=program):
    """The report of one conversation's rows after damage, in order."""
    marks, at = faults(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, text = solve(rows)
    pairs = [(a[1][:1], b[1][:1]) for a, b in itertools.pairwise(rows)]
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in text).encode()).hexdigest()
    return (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, digest)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        one = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{one[0]}:{one[1]}".encode()) % 20
        role, text = "user" if kind == 4 else one[2], "" if kind == 1 else re.sub("[.!?]", "", one[3]) if kind == 2 else one[3]
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def ordered(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest())
    return sorted(rows, key=key)


def by_conversation(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {c: ordered(r) for c, r in out.items()}


def make(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "c", 2, "f") for r in rows], SCHEMA).repartition(parts)


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


TEXTS = ("Yes.", "no", " ", "", "Why? ", "tail\n\n", "Ok!", "日本", "\x0b.")


def test_every_sequence_of_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(i, rng.choice(("user", "assistant", "system", "tool", "", "s")), rng.choice(TEXTS)) for i in range(rng.randint(0, 3))]
        want = every_sequence(rows)
        assert (want[0], want[1], tuple(want[2])) == program(rows)


def test_products_are_associative():
    rng = random.Random(4)
    some = [turns.product("".join(rng.choices("suaSUA-=x", k=rng.randint(1, 5)))) for _ in range(30)]
    for a, b, c in zip(some, some[1:], some[2:], strict=False):
        assert turns.times(turns.times(a, b), c) == turns.times(a, turns.times(b, c))
        assert turns.times(turns.IDENTITY, a) == a == turns.times(a, turns.IDENTITY)
    assert turns.times(turns.CLOSURE, turns.CLOSURE) == turns.CLOSURE


def test_reports(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(150):
        for i in range(rng.randint(0, 7)):
            turn = rng.choice((i, i, i, i, None, 2, -5, 40))
            rows.append((conv, turn, rng.choice(("user", "assistant", "assistant", "system", None, "tool", "")), rng.choice((*TEXTS, None))))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (9000, None, None, None), (9001, -(2**63), "user", "a."), (9001, 2**63 - 1, "assistant", "b.")]
    rows += [(9002, 1, "user", "again.")] * 40 + [(9003, 1, "user", "x" * 300_000 + "?")]
    want = {c: expected(own) for c, own in by_conversation(rows).items()}
    want[9001] = (2**63 - 1, *want[9001][1:])  # the span is no long
    assert got(turns.report(make(spark, rows))) == want


def test_damage_and_dropped_conversations(spark):
    rng = random.Random(6)
    rows = [(c, i, ("user", "assistant")[i % 2], rng.choice(TEXTS)) for c in range(200) for i in range(rng.randint(1, 6))]
    rows += [(None, None, None, None), (7, 3, None, "Null role."), (8, 3, "user", None), (300, 1, "user", "Twice."), (300, 1, "user", "Twice.")]
    want = by_conversation(damaged(rows))
    out = got(turns.report(turns.damage(make(spark, rows))))
    assert set(out) == {r[0] for r in rows} and any(not want.get(c) for c in out)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out == {c: expected(want[c]) if want.get(c) else nothing for c in out}


def test_long_conversations_cross_partitions(spark):
    rng = random.Random(7)
    rows = [(c, i, rng.choice(("user", "assistant", "assistant", "tool")), f"{i} " + rng.choice(("end.", "cut", "same."))) for c in (1, 2, 5) for i in range(2500 if c == 2 else 300)]
    rows += [(c, 0, "user", "short.") for c in range(10, 40)]
    rows += [(3, i, "user", "the same.") for i in range(900)]  # a hot text
    rows += [(4, None, "assistant", f"{i}.") for i in range(700)]
    want = {c: expected(own) for c, own in by_conversation(rows).items()}
    assert got(turns.report(make(spark, rows, 5))) == want
    parts = turns._cells(make(spark, rows, 5)).repartitionByRange(8, "conv_id", "turn", "role", "digest").selectExpr("conv_id", "spark_partition_id() AS p")
    assert parts.where("conv_id = 2").distinct().count() > 2  # one conversation, several tasks


def test_repaired_turns(spark):
    rng = random.Random(8)
    rows = [(c, i, rng.choice(("user", "assistant", "system")), rng.choice(TEXTS)) for c in range(80) for i in range(rng.randint(0, 6))]
    out = defaultdict(list)
    for r in sorted(turns.repair(make(spark, rows)).collect(), key=lambda r: (r.conv_id, r.position)):
        assert r.position == len(out[r.conv_id]) and r.edit in "KRI"
        out[r.conv_id].append((r.role, r.text))
    for c, own in by_conversation(rows).items():
        assert tuple(out.get(c, ())) == program(own)[2] and FORM.fullmatch("".join(r[0] for r, _ in out.get(c, ())))


@pytest.mark.parametrize("make_it", [turns.report, turns.repair])
def test_empty_table(spark, make_it):
    assert make_it(spark.createDataFrame([], SCHEMA)).count() == 0
