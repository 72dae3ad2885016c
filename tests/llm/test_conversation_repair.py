"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from shelfmark.llm import conversation_repair as cr
from shelfmark.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, present int, audit string, judged string"
WELL = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(key.encode()) % 20
        own = out.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of (turn, role, text) rows."""
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))

    # a state is what the initials so far match: nothing, s, ...u, ...ua
    def after(state, c):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, c))

    @functools.cache
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for name in ("user", "assistant"):
                to = after(state, name[0])
                if to:
                    found.append(join(2, "I", (name, ""), best(i, to, inserted + 1)))
        if i < len(rows):
            _, role, text = rows[i]
            found.append(join(3, "D", None, best(i + 1, state, 0)))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if after(state, role[:1]):
                    found.append(join(more, "K", (role, text), best(i + 1, after(state, role[:1]), 0)))
                for name in ("user", "assistant"):
                    if after(state, name[0]):
                        found.append(join(2 + more, "R", (name, text), best(i + 1, after(state, name[0]), 0)))
        return min((f for f in found if f), default=None)

    def join(cost, letter, turn, rest):
        return rest and (cost + rest[0], letter + rest[1], (*([turn] if turn else []), *rest[2]))

    cost, audit, out = best(0, "", 0)
    assert WELL.fullmatch("".join(r[:1] for r, _ in out))
    repaired = "\n".join(f"{r}:{t}" for r, t in out)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()


def made(seed=4, conversations=250):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        turns = rng.sample(range(30), rng.choice([1, 2, 3, 5, 8, 12]))
        for t in turns:
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([t, t, t, None, turns[0]]), role, rng.choice(["Hi.", "Well?\n", "cut", " \t", "", None, "é!", "x" * 400 + ".", f"t{t}", f"t{t}."])))
    rows += [(None, 1, "user", "a?"), (None, 2, "assistant", "b."), (9000, None, None, None)]
    return rows


def check(found, want):
    assert len(found) == len(want)
    for r in found:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == plain_repair(want[r.conv_id]), r.conv_id


def test_equals_search(spark):
    rows = made()
    df = spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA).repartition(5)
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    check(cr.repair(df).collect(), want)
    check(cr.repair(cr.damaged(df), there="present").collect(), plain_damage(rows))


def test_damaged_table(spark):
    data = "/root/testdata/sf0.01/conversations.parquet"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(data).collect()]
    check(queries.QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01").collect(), plain_damage(rows))


def test_turns_are_what_is_hashed(spark):
    df = spark.createDataFrame([(*r, 0, "", "") for r in made(9, 60)], SCHEMA)
    hashes = {r.conv_id: r.repaired_sha256 for r in cr.repair(df).collect()}
    out = {}
    for r in cr.turns(df).orderBy("place").collect():
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(out.get(c, [])).encode()).hexdigest() for c in hashes} == hashes


def test_long_conversation_has_few_vectors():
    rng = random.Random(2)
    repairer = cr.Repairer()
    symbols = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(50_000))
    cost, audit = repairer.repair(symbols)
    assert len(repairer._vectors) < 60 and sum(c != "I" for c in audit) == len(symbols) and cost > 0


def test_gone_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.repair(empty).collect() == [] and cr.turns(empty).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = cr.repair(cr.damaged(spark.createDataFrame([(gone, 0, "user", "x", 0, "", "")], SCHEMA)), there="present").first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("roles", [["user", "user"], ["assistant"], ["system"], ["system", "assistant", "user"]])
def test_small_cases(spark, roles):
    rows = [(1, i, r, f"{i}.") for i, r in enumerate(roles)]
    df = spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA)
    check(cr.repair(df).collect(), {1: [r[1:] for r in rows]})


def test_statement_equals_search():
    """The SQL form, over the same awkward rows."""
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", made())
    want = plain_damage(made())
    found = con.sql(queries.ORACLES["op12_conversation_repair"]).fetchall()
    assert len(found) == len(want) and all(tuple(row[1:]) == plain_repair(want[row[0]]) for row in found)
