"""Role repair against a plain search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

from rillwork.llm import role_repair
from rillwork.llm.role_repair import Row, repair_conversations

GOOD = re.compile(r"(s?(ua)+)?")
SOLID = re.compile("[^\x20\x09-\x0d]")


def cheapest(rows):
    """Least (cost, audit) of every initial string that edits of (initial, must_go, truncated) can give, by a table over rows and grammar places."""
    # places of the grammar: nothing, after s, after u, after a
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(best):
        for _ in range(4):
            for q, (c, s) in list(best.items()):
                for r in "ua":
                    if (q, r) in step:
                        to = step[q, r]
                        best[to] = min(best.get(to, (c + 3, s + "I")), (c + 3, s + "I"))
        return best

    best = {0: (0, "")}
    for initial, must_go, truncated in rows:
        best, old = {}, inserted(best)
        for q, (c, s) in old.items():
            ways = [(q, c + 4, s + "D")]
            if not must_go:
                more = 3 * truncated
                ways += [(step[q, initial], c + more, s + "K")] if (q, initial) in step else []
                ways += [(step[q, r], c + 3 + more, s + "R") for r in "ua" if (q, r) in step]
            for to, c2, s2 in ways:
                best[to] = min(best.get(to, (c2, s2)), (c2, s2))
    best = inserted(best)
    return min(best[q] for q in (0, 3) if q in best)


def all_edits(rows):
    """The same by trying every audit up to a length."""
    out = []
    for extra in range(len(rows) + 3):
        for spots in itertools.combinations_with_replacement(range(len(rows) + 1), extra):
            for edits in itertools.product("KRD", repeat=len(rows)):
                if any(e != "D" and must for e, (_, must, _) in zip(edits, rows)):
                    continue
                slots = []
                for i in range(len(rows) + 1):
                    slots += ["I"] * spots.count(i)
                    if i < len(rows):
                        slots.append((edits[i], rows[i]))
                free = [k for k, s in enumerate(slots) if s == "I" or s[0] == "R"]
                for roles in itertools.product("ua", repeat=len(free)):
                    pick = dict(zip(free, roles))
                    said = "".join(pick.get(k) or (s[1][0] if s[0] == "K" else "") for k, s in enumerate(slots))
                    if GOOD.fullmatch(said):
                        cost = sum(3 if s == "I" else {"K": 0, "R": 3, "D": 4}[s[0]] + 3 * (s[0] != "D" and s[1][2]) for s in slots)
                        out.append((cost, "".join(s if s == "I" else s[0] for s in slots)))
    return min(out)


def plain(rows):
    """conv_id -> the result's other columns, from (conv_id, turn, role, text) rows."""
    told = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        told[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in told.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        seen, faults = set(), []
        for _, role, text in own:
            solid = SOLID.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in own]
        items = [(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)]
        cost, audit = cheapest(items)
        said, place, at = [], "", iter(own)
        for e in audit:
            row = None if e == "I" else next(at)
            if e == "D":
                continue
            role = row[1] if e == "K" else "assistant" if place == "u" else "user"
            said.append(f"{role}:{row[2] if row else ''}")
            place = role[0]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, open int")
    got = repair_conversations(df.repartition(parts)).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_stack_search_is_the_least_of_all_edits():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice("suasuat"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(0, 4))]
        ways = role_repair.repair([Row(*r) for r in rows])
        got = min(ways[q][:2] for q in role_repair.TABLE.ends if q in ways)
        assert got == cheapest(rows) == all_edits(rows), rows


def test_chunk_maps_compose():
    rng = random.Random(6)
    for _ in range(100):
        rows = [Row(rng.choice("suauat"), rng.random() < 0.15, rng.random() < 0.15, rng.choice([1, 1, 1, 3])) for _ in range(rng.randrange(1, 14))]
        cut = rng.randrange(0, len(rows) + 1)
        whole = role_repair.repair(rows)
        joined = {}
        for a, (c, s, _) in role_repair.repair(rows[:cut]).items():
            for b, (c2, s2, _) in role_repair.repair(rows[cut:], a).items():
                joined[b] = min(joined.get(b, (c + c2, s + s2)), (c + c2, s + s2))
        ends = role_repair.TABLE.ends
        assert min(joined[q] for q in ends if q in joined) == min(whole[q][:2] for q in ends if q in whole)


def _talk(rng, conv, n):
    roles = ["user", "assistant"] * n
    out = [(conv, -1, "system", "Be kind.")] if rng.random() < 0.3 else []
    for t in range(n):
        role = rng.choice(["user", "assistant", "system", "tool", "", "umpire", None]) if rng.random() < 0.15 else roles[t]
        text = rng.choice(["Yes.", "No!", "Is it so? ", "cut off", "", "  \n", " ", None, f"It is {rng.randrange(99)}.\n", "ends ."])
        out.append((conv, rng.choice([t, t, t, t + 1, None]) if rng.random() < 0.2 else t, role, text))
    return out


def test_conversations_match_plain_search(spark):
    rng = random.Random(7)
    rows = [r for conv in range(250) for r in _talk(rng, conv, rng.randrange(0, 9))]
    rows += _talk(rng, None, 6) + [(900, None, "user", "Hi."), (901, 3, None, None), (902, 5, "assistant", "Only me.")]
    rows += [rows[3]] * 4  # repeated rows
    check(spark, rows)


def test_long_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(role_repair, "CHUNK_ROWS", 7)
    rng = random.Random(8)
    rows = _talk(rng, 1, 400) + [r for c in range(2, 40) for r in _talk(rng, c, 3)]
    rows += [(50, 1, "user", "Same.")] * 300 + [(50, 2, "assistant", "Yes.")] + [(51, t, "user", "word " * 50_000) for t in range(2)]
    check(spark, rows, 8)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = repair_conversations(empty)
    assert got.collect() == [] and got.columns[0] == "conv_id"
    gone = [(c, 0, "user", "Hi.") for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    check(spark, gone)
