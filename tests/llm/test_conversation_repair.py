"""Conversation repair: the DP against all edits, whole results against plain loops, and the SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import conversation_repair as cr
from sparkloom.llm.sql import REPAIR

SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind int, copies int, digest string, part string, told string"
SHAPE = re.compile(r"(s?(ua)+)?")


def search(turns, faults):
    """The least (cost, audit, repaired) over all edits of ``turns``, as (role, text)."""
    best = [(4 * len(turns) + 7, "", ())]

    def go(i, cost, audit, out):
        roles = "".join(r[:1] or "-" for r, _ in out)
        if cost > best[0][0] or not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if i == len(turns) and SHAPE.fullmatch(roles):
            best[0] = min(best[0], (cost, audit, out))
        if i < len(turns):
            role, text = turns[i]
            go(i + 1, cost + 4, audit + "D", out)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                go(i + 1, cost + more, audit + "K", (*out, (role, text)))
                for new in ("user", "assistant"):
                    go(i + 1, cost + more + 3, audit + "R", (*out, (new, text)))
        for new in ("user", "assistant"):
            go(i, cost + 3, audit + "I", (*out, (new, "")))

    go(0, 0, "", ())
    return best[0]


def brute(rows):
    """The contract in plain loops: conv_id to the measures."""
    convs = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        convs.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
        known = {t[0] for t in turns} - {None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        faults, seen = [], set()
        for _, role, text in turns:
            last = re.search(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, kept = search([t[1:] for t in turns], faults) if turns else (0, "", ())
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "d", "p", "t") for r in rows], SCHEMA)


def held(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def made(seed, conversations=60):
    random.seed(seed)
    texts = ["Yes.", "No!", "so", "  ", "", None, "why?\n", "Tail. \t", "x.y", "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "sage", "Admin"]
    rows = []
    for conv in range(conversations):
        for turn in range(random.randint(0, 5)):
            rows.append((conv, random.choice([turn, turn, turn, turn + 3, None]), random.choice(roles[: random.choice([4, 5, 10])]), random.choice(texts)))
    return rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("-sua"), st.sampled_from(["", "blank", "duplicate", "truncated"])), max_size=5))
def test_the_programme_finds_the_cheapest_and_least_audit(turns):
    want = search([({"s": "system", "u": "user", "a": "assistant", "-": "tool"}[i], "t") for i, _ in turns], [f for _, f in turns])
    faults = bytes(("", "blank", "duplicate", "truncated").index(f) for _, f in turns)
    assert cr.edits(bytes("-sua".index(i) for i, _ in turns), faults) == want[:2]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_loops(spark, seed):
    rows = made(seed) + [(None, 0, "user", "A null conversation."), (None, 1, "assistant", "Yes.")]
    assert held(cr.repair(table(spark, rows))) == brute(rows)


def test_the_sql_says_the_same(spark):
    rows = made(3) + [(None, 0, "user", "A null conversation."), (7, 2, "user", "é 中."), (7, 2, "user", "é 中.")]
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in db.execute(REPAIR).fetchall()} == held(cr.repair(table(spark, rows)))


def test_a_conversation_that_is_dropped_whole_is_told(spark):
    conv, turn = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert held(cr.repair(table(spark, [(conv, turn, "user", "Hello.")]))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_an_empty_table_gives_no_rows(spark):
    out = cr.repair(table(spark, []))
    assert out.count() == 0
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_a_long_conversation_and_a_very_long_text(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3_000)] + [(2, 1, "user", "word " * 300_000 + "end."), (2, 2, "assistant", "Yes.")]
    found = held(cr.repair(table(spark, rows)))
    dropped = sum(zlib.crc32(f"1:{t}".encode()) % 20 == 0 for t in range(1, 2_999))
    assert abs(found[1][0] - dropped) <= 1 and len(found[1][6]) >= 2_800 and set(found[1][6]) <= set("DIKR")
    assert len(found) == 2
