"""Conversation structure repair by iterative-deepening A*.

A conversation's rows, in order, are kept, given another role or deleted, and empty turns are put in, until the roles
read ``(s?(ua)+)?``. The cheapest such edits, of these the least in ASCII, are found by depth-first search in the ASCII
order of the edits (D, I, K, R) under a bound on the cost that rises to the least cost beyond it: the first path that is
accepted is the answer. What the faults of the remaining rows cost at least is the heuristic; a state that failed is
remembered with the cost that was left, through all bounds, and not searched again with as little.

Long conversations are cut into segments of SEGMENT rows. Each is searched from every role that may precede it to every
role that it may end with, and the answers are put together from left to right. That gives the same edits: two paths of
one cost through a segment, between the same states, hold as many row edits, so neither begins with the other.

Rows are dealt by conversation and sorted by Spark; a task sees them as a stream. It keeps a byte and a digest a row of
one conversation, and its texts, of which all beyond SPOOL bytes wait on disk until the edits are known. A conversation
isn't dealt to several tasks, as the hash asked for runs over its whole text in order.

Defined results: a null turn, role, text or conv_id is one space where a row is damaged, and a null or blank text is a
blank; rows of one turn are taken by role and text, so that their order is fixed; repeated rows count as often as they
come and are duplicates; rows without conv_id are one conversation; a role is told by its first character, other than
s, u and a it is never kept; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT, SPOOL = 64, 32 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: What the roles so far end with: nothing, a system turn, a user turn, an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may be put after each, and what the roles then end with.
NEXT = {NONE: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
NAMES = {"u": "user", "a": "assistant"}
FINAL = (NONE, ASSISTANT)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows as they are damaged; a dropped row stays with no copy, so that its conversation is known."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % 20
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    return rows.select("conv_id", "turn", F.when(what == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("copies"))


def edits(state: int, role: str, fault: str) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits of a row, in ASCII order. ``role`` is an initial, ``fault`` b, d, t or a space."""
    yield "D", DELETE, state
    if fault in "bd":
        return
    more = TRUNCATED if fault == "t" else 0
    wanted, after = NEXT[state]
    if role == wanted:
        yield "K", KEEP + more, after
    elif role == "s" and state == NONE:
        yield "K", KEEP + more, SYSTEM
    yield "R", REROLE + more, after


def least_costs(roles: str, faults: str) -> list[int]:
    """At each row, what it and those behind it cost at least, whatever the roles around them."""
    out = [0]
    for role, fault in zip(reversed(roles), reversed(faults), strict=True):
        own = DELETE if fault in "bd" else min(DELETE, (0 if role in "sua" else REROLE) + (TRUNCATED if fault == "t" else 0))
        out.append(out[-1] + own)
    return out[::-1]


class Search:
    """From any state before a run of rows to one of ``goals`` behind it. What has failed is kept for all starts and bounds."""

    def __init__(self, roles: str, faults: str, goals: tuple[int, ...]):
        self.roles, self.faults, self.goals = roles, faults, goals
        self.least = least_costs(roles, faults)
        self.failed: dict[tuple[int, int], int] = {}
        self.beyond = 0

    def within(self, at: int, state: int, left: int) -> str | None:
        """The first path in ASCII order that costs no more than ``left``, as letters from its end."""
        if self.least[at] > left:
            self.beyond = min(self.beyond, self.least[at] - left)
            return None
        if self.failed.get((at, state), -1) >= left:
            self.beyond = min(self.beyond, 1)
            return None
        end = at == len(self.roles)
        if end and state in self.goals:
            return ""
        row = [] if end else list(edits(state, self.roles[at], self.faults[at]))
        insert = ("I", INSERT, NEXT[state][1])
        for letter, cost, after in sorted([*row, insert]):
            found = self.within(at + (letter != "I"), after, left - cost)
            if found is not None:
                return found + letter
        self.failed[at, state] = max(left, self.failed.get((at, state), -1))
        return None

    def cheapest(self, state: int) -> tuple[int, str] | None:
        """Cost and letters. Every goal but an untouched start can be reached by inserting; that one only by deleting all."""
        if self.goals == (NONE,) and state != NONE or self.goals == (SYSTEM,) and not (state == SYSTEM or state == NONE and "s" in self.roles):
            return None
        bound, most = self.least[0], DELETE * len(self.roles) + 3 * INSERT + TRUNCATED
        while bound <= most:
            self.beyond = 1 << 60
            found = self.within(0, state, bound)
            if found is not None:
                return bound, found[::-1]
            bound += max(1, self.beyond)
        return None


def cheapest_edits(roles: str, faults: str, segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a conversation, of these the least in ASCII."""
    if len(roles) <= segment:
        return Search(roles, faults, FINAL).cheapest(NONE)
    best = {NONE: (0, "")}
    for at in range(0, len(roles), segment):
        found: dict[int, tuple[int, str]] = {}
        for goal in (NONE, SYSTEM, USER, ASSISTANT):
            search = Search(roles[at : at + segment], faults[at : at + segment], (goal,))
            for state, (cost, letters) in best.items():
                one = search.cheapest(state)
                if one is not None:
                    found[goal] = min((cost + one[0], letters + one[1]), found.get(goal, (1 << 60, "")))
        best = found
    return min(best[s] for s in FINAL if s in best)


def repaired_lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of every turn that the edits leave."""
    state = NONE
    for letter in audit:
        if letter == "I":
            wanted, state = NEXT[state]
            yield NAMES[wanted] + ":"
            continue
        role, text = next(rows)
        if letter == "K" and role[:1] == "s":
            state = SYSTEM
            yield f"{role}:{text}"
        elif letter != "D":
            wanted, state = NEXT[state]
            yield f"{role if letter == 'K' else NAMES[wanted]}:{text}"


class Conversation:
    """One conversation's rows as they come, in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.roles, self.faults = bytearray(), bytearray()
        self.turns, self.first, self.last = 0, None, None
        self.seen: set[bytes] = set()
        self.places: list[tuple[int, int]] = []
        self.texts = tempfile.SpooledTemporaryFile(max_size=SPOOL)

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            if turn != self.last:
                self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        a, b = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
        name, bare = hashlib.blake2b(len(a).to_bytes(8, "little") + a + b, digest_size=16).digest(), text.strip(SPACES)
        self.faults += b"b" if not bare else b"d" if name in self.seen else b" " if bare[-1] in ".!?" else b"t"
        self.seen.add(name)
        self.roles += role[:1].encode() if role[:1] in ("s", "u", "a") else b"?"
        self.places.append((len(a), len(b)))
        self.texts.write(a + b)

    def rows(self) -> Iterator[tuple[str, str]]:
        self.texts.seek(0)
        for a, b in self.places:
            yield self.texts.read(a).decode("utf-8", "surrogatepass"), self.texts.read(b).decode("utf-8", "surrogatepass")

    def result(self) -> tuple:
        roles, faults = self.roles.decode(), self.faults.decode()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        illegal = sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
        cost, audit = cheapest_edits(roles, faults)
        digest = hashlib.sha256()
        for i, line in enumerate(repaired_lines(audit, self.rows())):
            digest.update((b"\n" if i else b"") + line.encode("utf-8", "surrogatepass"))
        self.texts.close()
        return (self.conv_id, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest.hexdigest())


SAID = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage."""
    return repaired(damaged(rows))


def repaired(rows: DataFrame) -> DataFrame:
    """The same for rows as they are: conv_id, turn, role, text, and copies, how often a row comes."""
    kind = dict(rows.dtypes)["conv_id"]
    dealt = rows.withColumn("turn", F.col("turn").cast("long")).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def run(batches):
        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [[]] * 9
            ids = pa.array(columns[0], id_type)
            return pa.record_batch([ids, *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], ["conv_id", *SAID])

        now, found, id_type = None, [], pa.null()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv_id, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        found.append(now.result())
                    now = Conversation(conv_id)
                for _ in range(copies):
                    now.add(turn, role, text)
            if len(found) >= 1000:
                yield out(found)
                found = []
        if now is not None:
            found.append(now.result())
        if found:
            yield out(found)

    return dealt.select("conv_id", "turn", "role", "text", "copies").mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
