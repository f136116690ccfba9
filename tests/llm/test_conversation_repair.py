"""Conversation repair: brute force over all edits, damage, odd rows, streams of long conversations."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from revlens.llm import conversation_repair as repair
from revlens.llm import queries
from revlens.sources.tables import table

ROWS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NOTHING = hashlib.sha256(b"").hexdigest()


def cheapest(turns):
    """(cost, audit) by trying every edit at every turn, without a parser: all strings of each state are kept."""
    def inserted(found):
        found = {k: dict(v) for k, v in found.items()}
        for _ in range(3):
            for state in list(found):
                for symbol, to in NEXT[state].items():
                    if symbol != "s":
                        for audit, cost in list(found[state].items()):
                            found.setdefault(to, {}).setdefault(audit + "I", cost + 2)
        return found

    now = inserted({"": {"": 0}})
    for initial, fault in turns:
        new = {}
        for state, ways in now.items():
            for audit, cost in ways.items():
                new.setdefault(state, {})[audit + "D"] = cost + 3
                if fault in ("blank", "duplicate"):
                    continue
                extra = fault == "truncated"
                if initial in NEXT[state]:
                    new.setdefault(NEXT[state][initial], {})[audit + "K"] = cost + extra
                for symbol, to in NEXT[state].items():
                    if symbol != "s":
                        new.setdefault(to, {})[audit + "R"] = cost + 2 + extra
        now = {k: dict(sorted(v.items(), key=lambda w: (w[1], w[0]))[:60]) for k, v in inserted(new).items()}
    return min((cost, audit) for state in ("", "a") for audit, cost in now.get(state, {}).items())


def expected(rows):
    """The report of every conversation of the (undamaged) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3][:64].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, marks = set(), []
        for _, _, role, text in mine:
            last = text.rstrip(WHITE)[-1:]
            fault = ("blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated")
            seen.add((role, text))
            marks.append((role[:1], fault))
        turns = [t for known, t, _, _ in mine if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(marks)
        lines, queue, turn = [], list(mine), "u"
        for letter in audit:
            role, text = "", ""
            if letter != "I":
                _, _, role, text = queue.pop(0)
            if letter == "D":
                continue
            if letter in "IR":
                role = {"u": "user", "a": "assistant"}[turn]
            turn = "a" if role[:1] == "u" else "u"
            lines.append(f"{role}:{text}")
        faults = [f for _, f in marks]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(rows):
    found = repair.repair_report(rows, repair.damage(rows))
    return {r.conv_id: tuple(r)[1:] for r in found.collect()}


def test_parser_equals_trying_all_edits():
    rng = random.Random(1)
    for _ in range(1500):
        turns = [(rng.choice("suax "), rng.choice([None] * 4 + ["blank", "duplicate", "truncated"])) for _ in range(rng.randrange(9))]
        parser = repair.Repair()
        for turn in turns:
            parser.read(*turn)
        assert parser.result() == cheapest(turns), turns


def test_stack_merges_equal_tops_and_stays_small():
    rng, parser = random.Random(2), repair.Repair()
    for _ in range(5000):
        parser.read(rng.choice("suax"), rng.choice([None, None, "blank", "truncated"]))
        assert len(parser.tops) <= 8
    cost, audit = parser.result()
    assert sum(x != "I" for x in audit) == 5000 and cost > 0


def test_automaton_of_the_role_grammar():
    lr = repair.Automaton(repair.GRAMMAR)

    def accepts(text):
        stacks = repair.Stacks(lr)
        tops = {stacks.start}
        for symbol in text:
            tops = {to for top in tops for to in stacks.after(top, symbol)}
        return any(stacks.accepts(top) for top in tops)

    for n in range(6):
        for k in range(3 ** n):
            text = "".join("sua"[k // 3 ** i % 3] for i in range(n))
            assert accepts(text) == bool(re.fullmatch(r"(s?(ua)+)?", text)), text


def test_query_on_the_small_table(spark):
    rows = table(spark, SF_SMALL, "conversations")
    want = expected([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    got = queries.op12_glr_repair(spark, SF_SMALL)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want


def test_odd_rows_ties_repeats_and_clashing_columns(spark):
    rng = random.Random(3)
    big = 2 ** 60 + 1
    rows = [(1, None, None, None), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, "system", "S."), (2, 5, "", "x"),
            (2, 9, "weird", "y!"), (3, 1, "user", ""), (None, 1, "user", "no id?"), (None, None, "assistant", "Yes."),
            (4, 0, "user", "long " * 40_000 + "."), (4, 1, "assistant", "a\x00b. "), (big, 2, "user", "é!"),
            (big, big, "assistant", "ü?"), (7, 1, "user", None), (7, 1, "assistant", "b."), (7, 1, "assistant", "a.")]
    rows += [(100 + i // 5, rng.randrange(4), rng.choice(["user", "assistant", "system", "tool"]),
              rng.choice(["One.", "Two!", "Three", " ", "Four? "])) for i in range(300)]
    frame = spark.createDataFrame(rows, ROWS)
    for c in ("conv", "kind", "copies", "copy", "audit", "fault", "repeat", "digest", "head", "own", "step", "edit", "initial"):
        frame = frame.withColumn(c, F.lit("clash"))
    assert report(frame) == expected(rows)


def test_empty_tables_and_dropped_conversations(spark):
    none = spark.createDataFrame([], ROWS)
    assert report(none) == {}
    gone = [(c, 0, "user", "x.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    assert set(report(spark.createDataFrame(gone, ROWS)).values()) == {(0, 0, 0, 0, 0, 0, "", NOTHING)}


def test_a_long_conversation_passes_as_a_stream(spark):
    """One conversation over many Arrow batches: the script gives back its rows in order."""
    n = 30_000
    rows = (spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
                                  F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(".")).alias("text")))
    found = repair.diagnose(rows)
    audit = found.first().audit
    script = repair.repaired(rows, found).orderBy("step").toPandas()
    assert "".join(script["edit"]) == audit
    assert script.loc[script["edit"] != "I", "turn"].tolist() == list(range(n))
    roles = "".join(r[0] for r in script.loc[script["edit"] != "D", "role"])
    assert re.fullmatch(r"(s?(ua)+)?", roles)
    lines = script.loc[script["edit"] != "D", "role"] + ":" + script.loc[script["edit"] != "D", "text"]
    sha = repair.script_digest(repair.repaired(rows, found)).first().repaired_sha256
    assert sha == hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("text,fault", [("", "blank"), (" \t\x0b", "blank"), ("a. \n", None), ("a,", "truncated"),
                                        (" ", "truncated"), ("?", None)])
def test_fault_of(spark, text, fault):
    row = spark.createDataFrame([(text,)], "t string").select(repair.fault_of(F.col("t"), F.lit(False)).alias("f")).first()
    assert row.f == fault
