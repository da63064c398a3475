import functools
import hashlib
import random
import re
import zlib

import pytest

from gridloom.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Every conversation by a search from its end on: each answer is the least of all ways."""
    out, conversations = {}, {}
    for conv, turn, role, text in rows:
        own = conversations.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        own += [(turn is not None, turn or 0, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    for conv, own in conversations.items():
        own.sort()
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = text.strip(SPACE)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        step = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

        @functools.cache
        def best(k, state, inserted, own=own, faults=faults):
            ways = []
            if k == len(own) and state in (0, 3):
                ways.append((0, "", ()))
            if inserted < 3:
                cost, audit, made = best(k, step[state][1], inserted + 1)
                ways.append((cost + 3, "I" + audit, ((step[state][0], ""), *made)))
            if k < len(own):
                _, _, role, text = own[k]
                cost, audit, made = best(k + 1, state, 0)
                ways.append((cost + 4, "D" + audit, made))
                if faults[k] not in (1, 2):
                    more = 3 if faults[k] == 3 else 0
                    cost, audit, made = best(k + 1, step[state][1], 0)
                    ways.append((cost + 3 + more, "R" + audit, ((step[state][0], text), *made)))
                    after = 1 if state == 0 and role[:1] == "s" else step[state][1] if role[:1] == step[state][0][0] else None
                    if after:
                        cost, audit, made = best(k + 1, after, 0)
                        ways.append((cost + more, "K" + audit, ((role, text), *made)))
            return min(ways, default=(10**9, "", ()))

        cost, audit, made = best(0, 0, 0)
        turns = [t for there, t, *_ in own if there]
        initials = [r[:1] for _, _, r, _ in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def made(seed, n=150, turns=12):
    rng = random.Random(seed)
    texts = ["Hi.", "hello", "Yes!", "", " \n", "no?  ", "é.", "done.\x0b", "A. B", "."] + [f"line {k}." for k in range(20)]
    rows = []
    for conv in range(n):
        for turn in sorted(rng.sample(range(-70, 70), rng.randrange(0, turns))):
            rows.append((conv * 7, rng.choice([turn] * 9 + [None, 3]), rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "sys"]), rng.choice([*texts, None])))
    return rows


def got_of(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    assert got_of(C.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 7])
def test_long_conversations_are_cut_into_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(C, "BATCH_ROWS", size)
    rng = random.Random(size)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b.", "c", f"{t}!"])) for t in range(150)] + [(2, 5, "user", "same.")] * 30 + [(3, None, "user", f"{k % 6}.") for k in range(40)] + made(5, 10)
    assert got_of(C.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))) == brute(rows)


def test_odd_rows(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "gone."), (None, None, None, None), (None, 4, "user", "x " * 300_000 + "."), (None, 4, "user", "x " * 300_000 + "."), (-3, 2**40, "assistant", "a."), (-3, -(2**40), "user", "q?")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    got = got_of(C.repair_conversations(docs))
    assert got == brute(rows) and got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.repair_conversations(docs.limit(0)).count() == 0


def test_repaired_turns(spark):
    rows = spark.createDataFrame([("a", 1, "assistant", "x."), ("a", 2, "user", "y."), ("b", 1, "system", "s."), ("b", 2, "user", "q."), ("b", 3, "assistant", "r.")], "conv_id string, turn int, role string, text string")
    found = {}
    for r in sorted(C.repaired_rows(rows).collect()):
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    # Two insertions cost as much as two changed roles, and come first by letters.
    assert found == {"a": [("user", ""), ("assistant", "x."), ("user", "y."), ("assistant", "")], "b": [("system", "s."), ("user", "q."), ("assistant", "r.")]}


def test_moves_are_complete():
    assert C.edits(C.START, "s", C.CLEAN)[C.SYSTEM] == (0, "K") and C.edits(C.USER, "u", C.CLEAN)[C.ASSISTANT] == (3, "R")
    assert set(C.edits(C.ASSISTANT, "a", C.BLANK)) == {C.ASSISTANT, C.USER} and C.edits(C.USER, "a", C.CUT_OFF)[C.ASSISTANT] == (3, "K")
