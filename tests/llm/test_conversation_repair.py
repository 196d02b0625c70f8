import hashlib
import itertools
import random
import re
import zlib

import pytest

from geoquarry.llm import conversation_repair, earley
from geoquarry.llm.conversation_repair import damage, repair, repair_digests

WHITE = "[\x20\x09-\x0d]"


def targets(n):
    return [p + "ua" * k for k in range(n) for p in ("", "s") if k or not p]


def ways(tokens, goal):
    """Every (cost, audit) that edits ``tokens`` into the role initials ``goal``."""
    if not tokens and not goal:
        yield 0, ""
        return
    if goal and goal[0] != "s":
        for c, a in ways(tokens, goal[1:]):
            yield c + 2, "I" + a
    if tokens:
        t = tokens[0]
        for c, a in ways(tokens[1:], goal):
            yield c + 3, "D" + a
        if goal and t != "d":
            flaw = int(t.isupper())
            for c, a in ways(tokens[1:], goal[1:]):
                if t.lower() == goal[0]:
                    yield c + flaw, "K" + a
                if goal[0] != "s":
                    yield c + flaw + 2, "R" + a


def cheapest(tokens):
    return min(w for goal in targets(len(tokens) // 2 + 3) for w in ways(tokens, goal))


def test_parser_against_every_edit():
    rnd = random.Random(1)
    some = ["".join(t) for n in range(4) for t in itertools.product("suaxUd", repeat=n)]
    some += ["".join(rnd.choices("suaxSUAXd", k=rnd.randrange(4, 6))) for _ in range(60)]
    for tokens in some:
        found = earley.parse(tokens)
        assert min(found[s] for s in earley.COMPLETE if s in found) == cheapest(tokens), tokens


def test_blocks_compose():
    rnd = random.Random(2)
    for _ in range(40):
        tokens = "".join(rnd.choices("suaxSUAXd", weights=[1, 6, 6, 1, 1, 2, 2, 1, 1], k=rnd.randrange(2, 60)))
        cut = rnd.randrange(len(tokens))
        whole = {}
        for s, (c, a) in earley.parse(tokens[:cut]).items():
            for to, (more, b) in earley.parse(tokens[cut:], s).items():
                whole[to] = min(whole.get(to, (1 << 60, "")), (c + more, a + b))
        assert whole == earley.parse(tokens)


def brute(rows):
    """The contract: damage, faults, edits by the parser that is tested above, lines."""
    after, out = {}, []
    for conv, turn, role, text in rows:
        after.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        after[conv] += [(turn, "user" if k == 4 else role, text)] * (1 + (k == 3))
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults, tokens = set(), [], ""
        for _, role, text in own:
            bare = re.sub(WHITE, "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            i = role[:1] if role[:1] in ("s", "u", "a") else "x"
            tokens += "d" if fault in ("blank", "duplicate") else i.upper() if fault else i
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        found = earley.parse(tokens)
        cost, audit = min(found[s] for s in earley.COMPLETE if s in found)
        if len(tokens) <= 5:
            assert (cost, audit) == cheapest(tokens)
        lines, at = [], 0
        n = len(audit) - audit.count("D")
        for letter in audit:
            due = "user" if (len(lines) - n % 2) % 2 == 0 else "assistant"
            if letter in "KR":
                lines.append(f"{own[at][1] if letter == 'K' else due}:{own[at][2]}")
            if letter == "I":
                lines.append(f"{due}:")
            at += letter != "I"
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, at long, block string, kept int"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", 2) for r in rows], SCHEMA).repartition(5)


def odd_rows():
    rnd, rows = random.Random(4), []
    for conv in range(120):
        for turn in range(rnd.randrange(1, 9)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rnd.choice([f"Word {rnd.randrange(4)}.", f"what {rnd.randrange(30)}?", "no end", "", " \t\n", None, "é!\x0b", "line\nline."])
            rows.append((conv, rnd.choice([turn, turn, turn + 2, None]), role, text))
    rows += rows[10:20] + [(None, 1, "user", "a."), (None, None, None, None), (None, 2, "assistant", "b.")]
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(400)] + [(901, t, "x", f"{t}.") for t in range(301)]
    return rows + [(902, 0, "user", "long " * 100_000 + ".")] + [(903, 7, "user", "same.")] * 50


@pytest.mark.parametrize("block", [12, 4])
def test_query_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)  # 16 rows a block: long conversations are parsed in parts
    monkeypatch.setattr(conversation_repair, "AT_ONCE", 40)
    rows = odd_rows()
    got = repair_digests(frame(spark, rows)).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_dropped_conversations_and_none(spark):
    gone = [(c, t, "user", "a.") for c in range(40) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    got = repair_digests(frame(spark, gone)).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())} and len(got) == len({r[0] for r in gone})
    assert repair_digests(frame(spark, gone[:1]).limit(0)).count() == 0
    assert damage(frame(spark, gone)).count() == 0


def test_messages(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Why?"), (1, 1, "assistant", "Why?"), (1, 2, "user", "No."), (1, 3, "tool", "Done"), (2, 0, "assistant", " "), (3, 5, "unicorn", "Hm.")]
    messages, report = repair(frame(spark, rows))
    told = [tuple(r) for r in messages.select("conv_id", "place", "role", "text", "edit").orderBy("conv_id", "place").collect()]
    assert told[:5] == [(1, 0, "system", "Be brief.", "K"), (1, 1, "user", "", "I"), (1, 2, "assistant", "Why?", "K"), (1, 3, "user", "No.", "K"), (1, 4, "assistant", "Done", "R")]
    assert told[5:] == [(3, 0, "unicorn", "Hm.", "K"), (3, 1, "assistant", "", "I")]
    by = {r.conv_id: r for r in report.collect()}
    assert (by[1].duplicate, by[1].truncated, by[1].illegal, by[1].cost, by[1].audit) == (1, 1, 3, 8, "KIKDKR")
    assert (by[2].blank, by[2].audit, by[3].cost, by[3].audit) == (1, "D", 2, "KI")
