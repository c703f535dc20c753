"""Conversation repair against a search over all edits, on hostile rows, long conversations and small segments."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from groundlane.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos long, key string"


def rows_of(rng, n_convs=60):
    out = []
    for c in range(n_convs):
        for t in range(rng.randint(0, 7)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "using"])
            text = rng.choice(["Fine.", "So it is!", "cut off", "", " \n", None, "Again?", f"own {c} {t}.", "Twice.\t ", "…", "x." + "\x85"])
            out.append((c, rng.choice([t, t, t, t + 2, None]), role, text))
    return out + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (7, 1, "user", "Same."), (7, 1, "user", "Same.")]


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(c, t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired text) by a search from state to state in order of (cost, audit), over single edits."""
    faults, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return faults, cost, audit, "\n".join(made)
        # Of audits at one place and state the first met is the least of its cost, and none of them is a prefix of another.
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if role[0] in moves[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*made, f"{role}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] in moves[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*made, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in moves[state]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, new[0], (*made, f"{new}:{text}")))


def expected(originals, rows):
    digest = lambda role, text: hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    out = {}
    for c in {r[0] for r in originals}:
        own = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
        turns = [t for t, _, _ in own if t is not None]
        faults, cost, audit, text = cheapest([r[1:] for r in own])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own[:-1], own[1:], strict=True))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def wide(rows):
    return [(*r, "x", 1, "y") for r in rows]


@pytest.mark.parametrize("size,fan", [(256, 64), (3, 2)])
def test_repair_is_the_cheapest(spark, size, fan):
    rows = rows_of(random.Random(size))
    df = spark.createDataFrame(wide(rows), SCHEMA)
    assert found(conversations.report(df, conversations.damaged(df), size, fan)) == expected(rows, damage(rows))


def test_a_long_conversation_is_composed_of_segments(spark):
    rng = random.Random(5)
    rows = [(1, t // 2 if t % 50 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", f"{t}.", "cut", ""])) for t in range(700)] + [(2, 0, "user", "Only.")]
    df = spark.createDataFrame(wide(rows), SCHEMA).repartition(5)
    assert found(conversations.report(df, df, 16, 3)) == expected(rows, rows)


def test_repaired_turns_and_no_rows(spark):
    df = spark.createDataFrame(wide([(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", " ")]), SCHEMA)
    turns = conversations.repaired(conversations.repairs(df)).orderBy("pos", "k").collect()
    assert [(r["role"], r["text"]) for r in turns] == [("user", "A."), ("assistant", "B.")]
    gone = found(conversations.report(df, df.limit(0)))
    assert gone == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversations.report(df.limit(0), df.limit(0)).count() == 0


def test_edges_are_all_ways():
    """Every state reaches each other one over each letter if a plain enumeration does, at its least cost."""
    for code, src, dst, cost, edits, makes in conversations.edges():
        fault, initial = divmod(ord(code) - 65, 4)
        state, price = src, 0
        for e, m in zip(edits, makes, strict=True):
            role = {"=": conversations.INITIALS[initial]}.get(m, m.lower())
            price += {"I": 3, "D": 4, "K": 0, "R": 3}[e] + (3 if fault == 1 and e in "KR" else 0)
            state = state if e == "D" else conversations.MOVES[state][role]
        assert (state, price) == (dst, cost) and not (fault > 1 and edits[-1] != "D")
