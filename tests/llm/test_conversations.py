import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from urlintel.llm import conversations as c

VALID = re.compile("(s?(ua)+)?")


def cheapest(roles, faults, deepest):
    """All edit paths of at most ``deepest`` inserts, by themselves and not by the automaton."""
    best = None

    def go(i, cost, letters, out, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(roles) and VALID.fullmatch(out):
            best = min(best or (cost, letters), (cost, letters))
        if inserts < deepest:
            for role in "ua":
                go(i, cost + 3, letters + "I", out + role, inserts + 1)
        if i < len(roles):
            go(i + 1, cost + 4, letters + "D", out, inserts)
            if faults[i] not in "bd":
                more = 3 if faults[i] == "t" else 0
                go(i + 1, cost + more, letters + "K", out + roles[i], inserts)
                for role in "ua":
                    go(i + 1, cost + 3 + more, letters + "R", out + role, inserts)

    go(0, 0, "", "", 0)
    return best


@pytest.mark.parametrize("n", range(5))
def test_every_short_conversation(n):
    for roles in product("sua?", repeat=n):
        for faults in product(" bt", repeat=n) if n < 4 else [" " * n, " tb ", "t  b", "tttt"]:
            assert c.cheapest_edits("".join(roles), "".join(faults)) == cheapest("".join(roles), "".join(faults), n + 1), (roles, faults)


def test_segments_give_the_same_edits():
    r = random.Random(5)
    for _ in range(150):
        n = r.randint(3, 40)
        roles = "".join(r.choice("suauaua?") for _ in range(n))
        faults = "".join(r.choice("     bdt") for _ in range(n))
        whole = c.cheapest_edits(roles, faults, 1000)
        assert whole == c.cheapest_edits(roles, faults, 3) == c.cheapest_edits(roles, faults, 7), (roles, faults)


def test_long_conversation():
    r = random.Random(6)
    n = 3000
    cost, audit = c.cheapest_edits("s" + "".join(r.choice("ua") for _ in range(n)), " " + "".join(r.choice("   bt") for _ in range(n)))
    assert len(audit.replace("I", "")) == n + 1 and cost > n


def brute(rows):
    """From rows (conv_id, turn, role, text) as they are, by the contract."""
    groups = {x[0]: [] for x in rows}
    for conv, turn, role, text in rows:
        some = lambda x: " " if x is None else str(x)
        what = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        role, text = "user" if what == 4 else some(role), "" if what == 1 else re.sub("[.!?]", "", some(text)) if what == 2 else some(text)
        groups[conv] += [(turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        turns = {x[0] for x in own} - {None}
        seen, faults = set(), ""
        for _, role, text in own:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            faults += "b" if not bare else "d" if (role, text) in seen else " " if bare[-1] in ".!?" else "t"
            seen.add((role, text))
        roles = "".join(x[1][:1] or "?" for x in own)
        cost, audit = cheapest(roles, faults, len(own) + 1)
        lines, at, now = [], iter(own), ""
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else next(at)
            if letter in "IR":
                role = {"u": "user", "a": "assistant"}["a" if now[-1:] == "u" else "u"]
            if letter != "D":
                lines.append(f"{role}:{text}")
                now += role[:1]
        assert VALID.fullmatch(now)
        illegal = sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    """Null in every column, ties, repeated rows, blank and other roles, conversations of which all rows are dropped."""
    r, rows = random.Random(8), []
    for conv in [*range(120), None]:
        for turn in range(r.randint(1, 4)):
            text = r.choice(["Hi.", "Yes!", "no end", "", " \n", None, "é?", "Hi. \t", "a.b"])
            rows.append((conv, r.choice([turn, turn, turn, turn + 2, None]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), text))
    rows += rows[:6]
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, copies int").repartition(3)
    assert sorted(map(tuple, c.repair(df).collect()), key=str) == brute(rows)


def test_long_texts_and_spool(spark, monkeypatch):
    monkeypatch.setattr(c, "SPOOL", 1000)
    rows = [(i, j, "user" if j % 2 == 0 else "assistant", "wörd " * 50_000 + f"{j}.") for i in range(3) for j in range(4)]
    got = sorted(map(tuple, c.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert c.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
