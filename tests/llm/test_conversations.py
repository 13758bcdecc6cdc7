"""Conversation repair against Dijkstra's algorithm and a plain walk over every conversation."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from schemaloom.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, copies int, other string"


def cheapest(initials, faults, entry=0, goal=None):
    heap, seen, n = [(0, "", 0, entry)], set(), len(faults)
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == n and goal is not None:
            if state == goal:
                return cost, edits
            continue
        if i == n and state in (0, 3):
            return cost, edits
        nxt = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 3, edits + "I", i, nxt))
        if i == n:
            continue
        heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state))
        if faults[i] not in "bd":
            extra = 3 if faults[i] == "t" else 0
            kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, initials[i]))
            if kept is not None:
                heapq.heappush(heap, (cost + extra, edits + "K", i + 1, kept))
            heapq.heappush(heap, (cost + 3 + extra, edits + "R", i + 1, nxt))
    return None


def test_search_is_cheapest_and_least():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(0, 8)
        initials, faults = "".join(rng.choices("suat", [1, 4, 4, 1], k=n)), "".join(rng.choices("bdt-", k=n))
        assert c.search(initials, faults) == cheapest(initials, faults)
        if n:
            for entry in range(4):
                for goal in range(4):
                    assert c.search(initials, faults, entry, goal) == cheapest(initials, faults, entry, goal), (initials, faults, entry, goal)


def by_hand(rows):
    """Result of one conversation from damaged rows, by definition."""
    rows = [r for r in rows for _ in range(r[4])]
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for r in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", r[3])
        faults.append("b" if not re.search(r"[^\x20\x09-\x0D]", r[3]) else "d" if (r[2], r[3]) in seen else "t" if body[-1] not in ".!?" else "-")
        seen.add((r[2], r[3]))
    initials = "".join(r[2][:1] or "\0" for r in rows)
    cost, audit = cheapest(initials, "".join(faults))
    lines, i, roles = [], 0, ""
    for e in audit:
        if e != "D":
            role = rows[i][2] if e == "K" else "assistant" if roles[-1:] == "u" else "user"
            roles += role[0]
            lines.append(role + ":" + ("" if e == "I" else rows[i][3]))
        i += e != "I"
    assert re.fullmatch("(s?(ua)+)?", roles)
    turns = {r[1] for r in rows} - {None}
    illegal = sum(initials[k:k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(spark, rows, **sizes):
    found = {r[0]: tuple(r[1:]) for r in c.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert found == {k: by_hand(v) for k, v in groups.items()}


def make_rows(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant"] if rng.random() < .3 else [["user", "assistant"][turn % 2]]) if turn or rng.random() < .5 else "system"
            text = rng.choice(["Yes.", "No!", "cut off", " ", "", f"Said {turn}.", f"Asked {turn}? \n"])
            rows.append((conv if conv else None, None if rng.random() < .05 else turn, " " if rng.random() < .05 else role, text, rng.choice([1, 1, 1, 2]), "x"))
    return rows + [(10_000, 0, None, None, 0, None), (10_001, None, " ", " ", 1, None), (10_002, 3, "", "No role.", 1, None)]


@pytest.mark.parametrize("sizes", [{}, {"whole_rows": 3, "piece_rows": 2}, {"whole_rows": 1, "piece_rows": 1}])
def test_repair_equals_walk(spark, sizes):
    check(spark, make_rows(5, 60, 9), **sizes)


def test_hot_conversation_and_repeated_rows(spark):
    """One conversation with most of the rows, crossing ranges; rows that are all equal."""
    rng = random.Random(8)
    rows = [(7, t, ["user", "assistant"][t % 2] if rng.random() < .9 else "user", "Hm." if rng.random() < .2 else f"Line {t}" + rng.choice(".!?,"), 1, None) for t in range(900)]
    rows += [(8, 0, "user", "Same.", 1, None)] * 300 + [(9, None, "assistant", "x" * 200_000, 2, None)]
    check(spark, rows + make_rows(2, 5, 5), whole_rows=64, piece_rows=32)


def test_empty_table(spark):
    assert c.repair(c.damage(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).collect() == []


def test_damage(spark):
    rows = [(conv, turn, "assistant", "One. Two! Three?") for conv in range(40) for turn in (None, 0, 1)] + [(None, None, None, None)]
    got = {}
    for r in c.damage(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect():
        got[(r.conv_id, r.turn)] = (r.role, r.text, r.copies)
    kinds = set()
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kinds.add(min(kind, 5))
        role, text = role or " ", text or " "
        want = {0: (None, None, 0), 1: (role, "", 1), 2: (role, text.translate(str.maketrans("", "", ".!?")), 1), 3: (role, text, 2), 4: ("user", text, 1)}
        assert got[(conv, turn)] == want.get(kind, (role, text, 1))
    assert kinds == set(range(6))
