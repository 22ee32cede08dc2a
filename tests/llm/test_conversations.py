"""Conversation repair against an enumeration of all edits, and on odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from factorloom.llm import conversations
from factorloom.llm.conversations import Determinised, conversation_digests, repair_conversations
from factorloom.llm.registry import OP11_SQL, op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = {"u": "user", "a": "assistant"}


def cheapest(turns, most=2):
    """(cost, audit, lines) by trying every edit of every turn, and up to ``most`` inserted turns in each gap."""
    best, seen = None, set()
    options = []
    for role, text in turns:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        must_go = not body or (role, text) in seen
        seen.add((role, text))
        extra = 5 if body and body[-1] not in ".!?" else 0
        options.append([(2, "D", None)] + ([] if must_go else [(extra, "K", (role, text)), *[(1 + extra, "R", (n, text)) for n in NAMES.values()]]))
    gaps = [(5 * k, "I" * k, [(NAMES[c], "") for c in named]) for k in range(most + 1) for named in itertools.product("ua", repeat=k)]
    for chosen in itertools.product(*options):
        for filled in itertools.product(gaps, repeat=len(turns) + 1):
            cost = sum(c for c, _, _ in chosen) + sum(c for c, _, _ in filled)
            if best and cost > best[0]:
                continue
            lines, audit = list(filled[0][2]), filled[0][1]
            for (_, letter, line), (_, more, named) in zip(chosen, filled[1:], strict=True):
                lines += ([line] if line else []) + named
                audit += letter + more
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    return best


def test_every_edit_is_tried(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(60):
        turns = [(rng.choice(["system", "user", "assistant", "assistant", "tool", "", "User"]), rng.choice(["Yes.", "no", " ", "Why?", "x. \n"])) for _ in range(rng.randint(1, 3))]
        ordered = [(conv, t, r, x) for t, (r, x) in enumerate(turns)]
        rows += ordered
        want[conv] = cheapest(turns)
    found, repaired = repair_conversations(spark.createDataFrame(rows, SCHEMA))
    digests = {r.conv_id: r.sha256 for r in conversation_digests(repaired).collect()}
    got = {r.conv_id: r for r in found.collect()}
    assert set(got) == set(want)
    for conv, (cost, audit, lines) in want.items():
        assert (got[conv].cost, got[conv].audit) == (cost, audit)
        assert digests.get(conv, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(lines.encode()).hexdigest()


def test_states_are_few_and_reused():
    automaton = Determinised()
    word = "".join(random.Random(1).choices("suaoSUAOx", k=20_000))
    automaton.trace(word, conversations.END, 0)
    assert len(automaton.vectors) < 200 and len(automaton.table) < 9 * len(automaton.vectors) + 1


def test_blocks_of_a_long_conversation_fit_together(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "", f"text {t}."])) for c, n in ((1, 300), (2, 7), (None, 90)) for t in range(n)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = {r.conv_id: r for r in repair_conversations(frame)[0].collect()}
    monkeypatch.setattr(conversations, "BLOCK_BITS", 2)
    cut, repaired = repair_conversations(frame)
    assert {r.conv_id: r for r in cut.collect()} == whole
    lines = {}
    for r in repaired.orderBy("place").collect():
        lines.setdefault(r.conv_id, []).append(r.role[0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in lines.values())


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (7, 1, "user", "Hi."), (7, 1, "user", "Hi."), (7, None, "assistant", "Ho."), (8, 2, "user", "a" * 200_000 + "."), (8, 5, "assistant", "b!")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as at", "2 as conv", "3 as block")
    found, repaired = repair_conversations(frame)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in found.collect()}
    # of conversation 7 the assistant comes first, its turn being null
    assert got[None] == (0, 1, 0, 0, 1, 4, "DD") and got[8] == (2, 0, 0, 0, 0, 0, "KK")
    assert got[7][:5] == (0, 0, 1, 0, 1) and got[7][5] == cheapest([("assistant", "Ho."), ("user", "Hi."), ("user", "Hi.")])[0]
    assert sorted((r.role, len(r.text)) for r in repaired.where("conv_id = 8").collect()) == [("assistant", 2), ("user", 200_001)]
    empty, none = repair_conversations(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and none.count() == 0


def test_registered_query(spark, sf, tmp_path):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = sorted(map(tuple, con.execute(OP11_SQL).fetchall()))
    got = op11_conversation_repair(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect())) == want
    # a conversation that loses all its rows is still there
    from zlib import crc32

    gone = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    row = op11_conversation_repair(spark, str(tmp_path)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("turns", [[("user", "Hi.")], [("assistant", "Ho."), ("user", "Hi.")], [("system", "S."), ("assistant", "A.")]])
def test_trace_alone(turns):
    automaton = Determinised()
    word = "".join(r[0] for r, _ in turns)
    codes, last = automaton.trace(word, conversations.END, 0)
    audit = ("".join(codes) + conversations.closing(last)).translate(str.maketrans("uaUA", "IIRR"))
    assert (automaton.costs(word, conversations.END)[0], audit) == cheapest(turns)[:2]
