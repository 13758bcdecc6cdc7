"""Repair of the turn structure of conversations by iterative-deepening A*.

A conversation is in order if its role initials read ``(s?(ua)+)?`` and no row is blank,
repeated or truncated. The cheapest edits that bring it there are searched depth first in
the ASCII order of their initials (Delete, Insert, Keep, Rerole) under a rising bound on
the cost. A table remembers for every (row, state) that failed how much cost it needs at
least, which also improves the bound; the first path accepted is the answer: the cheapest,
and among those the ASCII-least.

Spark sorts all rows by conversation and turn over range partitions, so no task holds a
group: a task reads its sorted range once and searches every conversation that lies in it
and has at most ``WHOLE_ROWS`` rows. Conversations that are longer or cross a border of
ranges are written out with their position and treated in pieces of ``PIECE_ROWS`` rows:
the search runs for each pair of states at the ends of a piece, the pieces are put together
by adding costs, and the text is hashed in order as a stream. Both ways give the same
result: edit strings of a piece that end with a row are never prefixes of each other, so
the least whole is made of least pieces.

Defined cases: a null conv_id is a conversation of its own; null turns come first; null
role and text are one space; rows of one turn are ordered by role, then by the MD5 of
their text; repeated rows are duplicates of the first; other columns are not read; an
empty table gives an empty result; a conversation without rows has zeros, no edits and the
hash of the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from schemaloom.session import materialize

WHOLE_ROWS = 512
PIECE_ROWS = 64
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NEVER = 1 << 40
#: States: nothing yet, after the system row, user has spoken, assistant has spoken.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Edits after the last row that lead from a state to an accepted one.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def turn_after(state: int) -> int:
    """State after a user or assistant row that the state allows."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: str) -> int | None:
    """State after a row that is kept, or None if the role cannot stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return None


def floor_costs(initials: str, faults: str) -> list[int]:
    """Least cost of the rows from each position on, whatever their neighbours are."""
    out = [0] * (len(faults) + 1)
    for i in range(len(faults) - 1, -1, -1):
        odd = initials[i] not in "sua"
        row = DELETE if faults[i] in "bd" or (odd and faults[i] == "t") else TRUNCATED if faults[i] == "t" else REROLE if odd else 0
        out[i] = out[i + 1] + row
    return out


def search(initials: str, faults: str, entry: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and edits of the cheapest, then ASCII-least repair.

    ``faults`` has one of b (blank), d (duplicate), t (truncated), - per row. Without a goal
    the rows must end accepted; with one they must end in that state, with an edit of a row.
    None if the goal cannot be reached.
    """
    n = len(faults)
    if goal in (START, SYSTEM):  # only deletions lead there, but for one system row
        if entry == goal:
            return DELETE * n, "D" * n
        rows = [(TRUNCATED * (faults[i] == "t"), -i) for i in range(n) if initials[i] == "s" and faults[i] not in "bd"]
        if goal == START or entry != START or not rows:
            return None
        extra, at = min(rows)
        return DELETE * (n - 1) + extra, "D" * -at + "K" + "D" * (n - 1 + at)
    floor = floor_costs(initials, faults)
    needs: dict[int, int] = {}

    def moves(i: int, state: int) -> list[tuple[str, int, int, int]]:
        out = []
        if i < n:
            out.append(("D", DELETE, i + 1, state))
        if i < n or goal is None:
            out.append(("I", INSERT, i, turn_after(state)))
        if i < n and faults[i] not in "bd":
            extra = TRUNCATED if faults[i] == "t" else 0
            after = kept(state, initials[i])
            if after is not None:
                out.append(("K", extra, i + 1, after))
            out.append(("R", REROLE + extra, i + 1, turn_after(state)))
        return out

    bound = floor[0]
    while True:
        # A frame: place, budget left, moves, next move, least need seen among the moves.
        stack = [[(0 << 2) | entry, bound, None, 0, NEVER]]
        path: list[str] = []
        excess = NEVER
        while stack:
            frame = stack[-1]
            place, budget, options, at, least = frame
            i, state = place >> 2, place & 3
            if options is None:
                need = max(floor[i], needs.get(place, 0))
                if need > budget:
                    stack.pop()
                    if stack:
                        stack[-1][4] = min(stack[-1][4], need + stack[-1][1] - budget)
                        path.pop()
                    else:
                        excess = need - bound
                    continue
                if i == n and (state in (START, ASSISTANT) if goal is None else state == goal):
                    return bound - budget, "".join(path)
                options = frame[2] = moves(i, state)
            if at == len(options):
                needs[place] = max(needs.get(place, 0), least, budget + 1)
                stack.pop()
                if stack:
                    stack[-1][4] = min(stack[-1][4], needs[place] + stack[-1][1] - budget)
                    path.pop()
                else:
                    excess = needs[place] - bound
                continue
            frame[3] += 1
            edit, cost, to, after = options[at]
            if cost > budget:
                frame[4] = min(frame[4], cost + max(floor[to], needs.get((to << 2) | after, 0)))
                continue
            path.append(edit)
            stack.append([(to << 2) | after, budget - cost, None, 0, NEVER])
        bound += excess


@lru_cache(maxsize=50_000)
def search_known(initials: str, faults: str, entry: int = START, goal: int | None = None) -> tuple[int, str] | None:
    return search(initials, faults, entry, goal)


def apply_edits(rows: list[tuple[str, str]], edits: str, state: int = START) -> list[str]:
    """The repaired ``role:text`` lines of rows (role, text)."""
    out, i = [], 0
    for edit in edits:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            state = kept(state, rows[i][0][:1])
            out.append(f"{rows[i][0]}:{rows[i][1]}")
        else:
            state = turn_after(state)
            out.append(f"{NAMES[state]}:{rows[i][1] if edit == 'R' else ''}")
        i += edit != "I"
    return out


def fault(text: str, repeated: bool) -> str:
    body = text.strip(SPACE)
    return "b" if not body else "d" if repeated else "t" if body[-1] not in ".!?" else "-"


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def initial(role: str) -> str:
    """First character; a role without any counts as one that fits nowhere."""
    return role[:1] or "\0"


def whole(turns: list, roles: list[str], texts: list[str]) -> dict:
    """Result of one conversation from its ordered rows."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for row in zip(roles, texts):
        faults.append(fault(row[1], row in seen))
        seen.add(row)
    initials = [initial(r) for r in roles]
    cost, audit = search_known("".join(initials), "".join(faults))
    known = {t for t in turns if t is not None}
    lines = apply_edits(list(zip(roles, texts)), audit)
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": illegal_pairs(initials), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def damage(rows: DataFrame) -> DataFrame:
    """Faults put into conversations by the checksum of ``conv_id:turn``; dropped rows stay as rows without role.

    conv_id, turn, role, text, copies (rows that stand for it: 0, 1 or 2).
    """
    def spaced(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    role, text = spaced("role"), spaced("text")
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 0, F.lit(None)).when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _read_ranges(rows: DataFrame, whole_rows: int) -> DataFrame:
    """One pass over sorted ranges: results of whole conversations, positions of all other rows."""
    conv = rows.schema["conv_id"]
    schema = StructType([conv, *StructType.fromDDL(f"done boolean, {RESULT}, part int, pos long, turn long, role string, text string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        done: list[dict] = []
        current, open_rows = None, None  # rows of the conversation that is read; whether they go out one by one
        held: list[tuple] = []

        def row(at, turn, role, text):
            return {"conv_id": current[0], "done": False, "part": part, "pos": at, "turn": turn, "role": role, "text": text}

        def close(last: bool):
            if current is None:
                return
            if open_rows or last:
                done.extend(row(*r) for r in held)
            else:
                present = [r for r in held if r[2] is not None]
                found = whole([r[1] for r in present], [r[2] for r in present], [r[3] for r in present])
                done.append({"conv_id": current[0], "done": True, **found})
            held.clear()

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")]
            for conv_id, turn, role, text, copies in zip(*columns):
                if current is None or current[0] != conv_id:
                    first = current is None
                    close(False)
                    current, open_rows = (conv_id,), first  # the first one may have begun in the range before
                for _ in range(max(1, copies)):
                    held.append((pos, turn, role, text))
                    pos += 1
                if len(held) > whole_rows:
                    open_rows = True
                if open_rows and len(held) >= whole_rows:
                    done.extend(row(*r) for r in held)
                    held.clear()
                if len(done) >= 2048:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow)
                    done = []
        close(True)  # the last one may go on in the next range
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return rows.mapInArrow(run, schema)


_PIECE = ("__key string, part int, block long, n long, head string, tail string, low long, high long, turns long, first_turn long, last_turn long, "
          "blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>, roles array<string>, texts array<string>")


def _pieces(open_rows: DataFrame, piece_rows: int) -> DataFrame:
    """Pieces of long conversations with the search result of every pair of end states."""
    open_rows = open_rows.withColumn("block", F.floor(F.col("pos") / piece_rows).cast("long"))
    present = open_rows.where(F.col("role").isNotNull())
    at = F.struct("part", "pos")
    same = ["__key", "role", "__md5"]
    keyed = present.select("__key", "part", "block", "pos", "role", F.md5(F.col("text").cast("binary")).alias("__md5"))
    repeated = keyed.groupBy(*same).agg(F.min(at).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    # A text may be repeated all through a hot conversation: its first place is sent to eight salts.
    repeated = repeated.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(8)])))
    again = (keyed.withColumn("__salt", (F.col("pos") % 8).cast("int")).join(repeated, [*same, "__salt"])
             .where(F.struct("part", "pos") > F.col("__first"))
             .groupBy(F.col("__key").alias("__key2"), F.col("part").alias("part2"), F.col("block").alias("block2"))
             .agg(F.collect_set("pos").alias("again")))  # at most one piece
    keys = ["__key", "part", "block"]

    def solve(_, rows: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=[f.split()[0] for f in _PIECE.split(", ")])
        rows = rows.sort_values("pos")
        positions, roles, texts = rows["pos"].tolist(), rows["role"].tolist(), rows["text"].tolist()
        turns = [int(t) for t in rows["turn"].dropna()]
        known = set(repeats["again"].iloc[0]) if len(repeats) else set()
        faults = "".join(fault(t, p in known) for p, t in zip(positions, texts))
        initials = [initial(r) for r in roles]
        found = [search_known("".join(initials), faults, s, e) for s in range(4) for e in range(4)]
        first = rows.iloc[0]
        return pd.DataFrame([{
            "__key": first["__key"], "part": first["part"], "block": first["block"], "n": len(rows), "head": initials[0], "tail": initials[-1],
            "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
            "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": illegal_pairs(initials),
            "costs": [c[0] if c else NEVER for c in found], "audits": [c[1] if c else None for c in found], "roles": roles, "texts": texts,
        }])

    rows = present.select(*keys, "pos", "turn", "role", "text").groupBy(*keys)
    return rows.cogroup(again.groupBy("__key2", "part2", "block2")).applyInPandas(solve, _PIECE)


_CHAIN = "__key string, part int, block long, entry int, exit int, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def join_pieces(pieces: pd.DataFrame) -> pd.DataFrame:
    """States at the ends of all pieces of a conversation on its cheapest, ASCII-least path; totals on every row.

    Needs ordered rows with the costs (16, entry by exit) and ranks of the edit strings by entry.
    """
    n = len(pieces)
    costs = np.array(pieces["costs"].tolist(), dtype=np.int64).reshape(n, 4, 4)
    ranks = np.array(pieces["ranks"].tolist(), dtype=np.int64).reshape(n, 4, 4)
    best = np.array([INSERT * len(CLOSING[s]) for s in range(4)], dtype=np.int64)
    choice = np.zeros((n, 4), dtype=np.int64)
    for k in range(n - 1, -1, -1):
        total = costs[k] + best[None, :]
        order = np.where(total == total.min(axis=1, keepdims=True), ranks[k], 99)
        choice[k] = order.argmin(axis=1)
        best = np.minimum(total[np.arange(4), choice[k]], NEVER)
    states = [START]
    for k in range(n):
        states.append(int(choice[k, states[-1]]))
    heads, tails = pieces["head"].tolist(), pieces["tail"].tolist()
    across = sum(a + b not in ("su", "ua", "au") for a, b in zip(tails, heads[1:]))
    turns = int(pieces["turns"].sum())
    timed = pieces.dropna(subset=["first_turn"])
    turns -= int((timed["first_turn"].to_numpy()[1:] == timed["last_turn"].to_numpy()[:-1]).sum())
    gaps = int(timed["high"].max() - timed["low"].min()) + 1 - turns if len(timed) else 0
    return pd.DataFrame({
        "__key": pieces["__key"], "part": pieces["part"], "block": pieces["block"], "entry": states[:-1], "exit": states[1:],
        "final": [k == n - 1 for k in range(n)], "gaps": gaps,
        **{c: int(pieces[c].sum()) for c in ("blank", "duplicate", "truncated")},
        "illegal": int(pieces["illegal"].sum()) + across, "cost": int(best[START]),
    })


def _finish(rows: DataFrame) -> DataFrame:
    """Edits and hash of long conversations, read piece by piece in order."""
    schema = StructType.fromDDL(f"__key string, {RESULT}")
    arrow = to_arrow_schema(schema)
    totals = RESULT_NAMES[:6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, audit, begun = hashlib.sha256(), [], False
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                edits = r["edits"] + (CLOSING[r["exit"]] if r["final"] else "")
                lines = apply_edits(list(zip(r["roles"], r["texts"])), edits, r["entry"])
                for line in lines:
                    hashed.update((b"\n" if begun else b"") + line.encode())
                    begun = True
                audit.append(edits)
                if r["final"]:
                    out.append({"__key": r["__key"], **{t: r[t] for t in totals}, "audit": "".join(audit), "repaired_sha256": hashed.hexdigest()})
                    hashed, audit, begun = hashlib.sha256(), [], False
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def _long(open_rows: DataFrame, piece_rows: int) -> DataFrame:
    """Results of conversations in pieces: conv_id and the result columns."""
    named = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    open_rows = open_rows.withColumn("__key", named)
    pieces = materialize(_pieces(open_rows, piece_rows), "conversation-pieces")

    def rank(s: int):
        """Place of each edit string among those of its entry state."""
        cells = [F.col("audits")[4 * s + e] for e in range(4)]
        return [sum((F.coalesce(o < c, F.lit(False)).cast("long") for o in cells), F.lit(0)) for c in cells]

    ranks = F.array(*[r for s in range(4) for r in rank(s)])
    narrow = pieces.withColumn("ranks", ranks).drop("audits", "roles", "texts")
    chain = narrow.groupBy("__key").applyInPandas(lambda p: join_pieces(p.sort_values(["part", "block"]).reset_index(drop=True)), _CHAIN)
    cells = pieces.select("__key", "part", "block", "audits", "roles", "texts")
    chosen = cells.join(chain, ["__key", "part", "block"]).withColumn("edits", F.expr("audits[entry * 4 + exit]")).drop("audits")
    found = _finish(chosen.repartition("__key").sortWithinPartitions("__key", "part", "block"))
    nothing = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in RESULT_NAMES[:6]]
    names = open_rows.groupBy("__key").agg(F.min("conv_id").alias("conv_id"))
    return names.join(found, "__key", "left").select(
        "conv_id", *nothing, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"))


def repair(rows: DataFrame, whole_rows: int = WHOLE_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Repair of every conversation: conv_id, counts of faults, cost, audit and the hash of the repaired lines.

    ``rows`` has conv_id, turn, role, text and copies, as ``damage`` returns them; rows without a role only keep
    their conversation in the result.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.md5(F.col("text").cast("binary")), F.col("__at")]
    ranges = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    read = materialize(_read_ranges(ranges, whole_rows), "conversations")
    done = read.where("done").select("conv_id", *RESULT_NAMES)
    return done.unionByName(_long(read.where("NOT done").select("conv_id", "part", "pos", "turn", "role", "text"), piece_rows))
