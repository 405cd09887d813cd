"""The cheapest edits of conversations against a plain search, whole and in pieces."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from tidewater.llm import queries, repair

KIND = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit) by search over places, states and inserts; turns are (initial, must go, extra cost)."""

    @functools.cache
    def best(i, state, inserts):
        found = [(0, "")] if i == len(turns) and state in (0, 3) else []
        go = lambda cost, letter, j, to, n: found.append((cost + (r := best(j, to, n))[0], letter + r[1]))
        speaks = {0: 2, 1: 2, 3: 2, 2: 3}[state]
        if inserts < 3:
            go(3, "I", i, speaks, inserts + 1)
        if i < len(turns):
            initial, must, more = turns[i]
            go(4, "D", i + 1, state, 0)
            if not must:
                if initial == "s" and state == 0:
                    go(more, "K", i + 1, 1, 0)
                if initial == {2: "u", 3: "a"}[speaks]:
                    go(more, "K", i + 1, speaks, 0)
                go(3 + more, "R", i + 1, speaks, 0)
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults, turns = set(), [], []
        for _, _, role, text in own:
            ink = text.strip(SPACE)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
            seen.add((role, text))
            turns.append((role[:1], faults[-1] in ("blank", "duplicate"), 3 if faults[-1] == "truncated" else 0))
        known = [t for _, t, _, _ in own if t is not None]
        cost, audit = cheapest(tuple(turns))
        lines, i, state = [], 0, 0
        for letter in audit:
            role, text = own[i][2:] if letter != "I" else ("", "")
            i += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[:1]]
            lines.append(f"{role}:{text}")
        pairs = [a[0] + b[0] for a, b in zip(turns, turns[1:], strict=False)]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(spark, rows):
    turns = spark.createDataFrame(rows, KIND).repartition(3)
    got = repair.digests(turns.select("conv_id").distinct(), repair.repair(repair.damaged(turns)))
    return {r[0]: tuple(r[1:]) for r in got.collect()}


def made(seed, conversations=60, turns=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "open", "open ", "end.\n ", "", " \t", "é。", "Yes. ", "(a.)", None]
    return [(c, rng.choice([t, t, t, None, t + 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for c in range(conversations) for t in range(rng.randrange(turns))]


@pytest.mark.parametrize("piece", [512, 3, 1])
def test_equals_plain_search(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = made(piece) + [(None, 0, "user", "a."), (None, 1, "assistant", "b.")] + [(900, 0, "user", "Same.")] * 5 + [(901, t, "system", "S.") for t in range(4)]
    assert found(spark, rows) == plain(rows)


def test_nothing_left_and_empty(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = found(spark, [(7, gone, "user", "x.")])
    assert got == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(spark, []) == {}


def test_repaired_turns_and_text_columns(spark):
    """The operator itself, undamaged: other names, a column more, the turns that it returns."""
    rows = [(1, 0, "user", "Hi.", "x"), (1, 1, "user", "Hello?", "x"), (1, 2, "assistant", "Yes", "x")]
    df = spark.createDataFrame(rows, "c long, t long, who string, said string, fault string")
    faults, turns = repair.repair(df, "c", "t", "who", "said")
    assert tuple(faults.select("cost", "audit", "truncated", "illegal").first()) == (6, "KIKK", 1, 1)
    assert [(t.role, t.text, t.edit) for r in turns.orderBy("piece").collect() for t in r.repaired] == [("user", "Hi.", "K"), ("assistant", "", "I"), ("user", "Hello?", "K"), ("assistant", "Yes", "K")]


def test_query_has_no_python(spark):
    plan = queries.op12_repair(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
