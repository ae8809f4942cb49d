"""Conversation repair against a plain search over all edits."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from graphfacts.llm import repair

SPACES = "\t\n\x0b\x0c\r "


def spoiled(rows):
    """``rows`` (conv, turn, role, text) after damage, by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        word = lambda v: " " if v is None else str(v)
        r = crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        if r == 0:
            continue
        text = "" if r == 1 else "".join(c for c in text if c not in ".!?") if r == 2 else text
        out[conv] += [(turn, "user" if r == 4 else role, text)] * (2 if r == 3 else 1)
    digest = lambda x: hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()
    return {conv: sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, digest(x))) for conv, own in out.items()}


def faults_of(own):
    seen, out = set(), []
    for _, role, text in own:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(own, faults):
    """Least (cost, audit, result) by dynamic programming over (rows consumed, what the roles read so far)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def widened(best):
        todo = list(best)
        while todo:
            state = todo.pop()
            cost, audit, rows = best[state]
            for c in after[state]:
                if c != "s":
                    way = (cost + 2, audit + "I", (*rows, ("user" if c == "u" else "assistant", "")))
                    if c not in best or way[:2] < best[c][:2]:
                        best[c] = way
                        todo.append(c)
        return best

    for (_, role, text), fault in zip(own, faults):
        found = {}

        def offer(state, way):
            if state not in found or way[:2] < found[state][:2]:
                found[state] = way

        for state, (cost, audit, rows) in widened(best).items():
            offer(state, (cost + 3, audit + "D", rows))
            if fault in ("blank", "duplicate"):
                continue
            extra = 1 if fault == "truncated" else 0
            if role[:1] in after[state]:
                offer(after[state][role[:1]], (cost + extra, audit + "K", (*rows, (role, text))))
            for c in after[state]:
                if c != "s":
                    offer(c, (cost + extra + 2, audit + "R", (*rows, ("user" if c == "u" else "assistant", text))))
        best = found
    return min((w for s, w in widened(best).items() if s in ("", "a")), key=lambda w: w[:2])


def expected(rows):
    out = {}
    for conv, own in spoiled(rows).items():
        faults = faults_of(own)
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, fixed = cheapest(own, faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(spark, rows, more=""):
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, fault string")
    got = repair.structure_repair(table).select(*COLUMNS).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def conversation(rnd, conv, n):
    out = []
    for turn in range(n):
        role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool"]) if rnd.random() < 0.3 else ("user", "assistant")[turn % 2]
        out.append((conv, turn, role, rnd.choice(["yes.", "no", " ", "Fine!", "why?  \n", f"t{turn}.", f"u{turn}"])))
    return out


def test_blocks_compose_to_the_cheapest_edits():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randint(1, 14)
        own = [(i, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["a.", "b", "", f"x{i}."])) for i in range(n)]
        faults = faults_of(own)
        tags = "".join(repair.TAGS["suax".find(r[0] if r[0] in "sua" else "x") * 3 + {None: 0, "truncated": 1}.get(f, 2)] for (_, r, _), f in zip(own, faults))
        want = cheapest(own, faults)[:2]
        codes, cost = repair.whole(tags)
        assert (cost, repair.letters(codes)) == want
        size = rnd.randint(1, 4)
        blocks = [tags[i:i + size] for i in range(0, n, size)]
        parts = [repair.table_of(b) for b in blocks]
        half = len(parts) // 2
        top = repair.joined([repair.joined(parts[:half]), repair.joined(parts[half:])] if half else parts)
        last = repair.last_state(top)
        states = repair.composed(parts, repair.EMPTY)[last][2]
        text = "".join(repair.letters(repair.crossings(b)[a, e][1]) for b, a, e in zip(blocks, [repair.EMPTY, *states], states))
        assert (top[last] + 2 * len(repair.CLOSING[last]), text + repair.letters(repair.CLOSING[last])) == want


@pytest.mark.parametrize("seed", range(2))
def test_repair_equals_search(spark, seed):
    rnd = random.Random(seed)
    rows = [r for conv in range(60) for r in conversation(rnd, conv, rnd.randint(1, 9))]
    rows += conversation(rnd, 1000, 700)  # eleven blocks and more
    rows += [(2000, t, "user", "again.") for t in range(300)]  # one row over and over
    rows += [(None, 0, "user", "hello."), (None, None, "assistant", "yes."), (None, 1, None, None)]
    rows += [(3000, None, None, None), (3001, None, "", "x"), (3002, 1, "user", ""), (3003, 5, "user", "long " * 50_000 + "."), (3003, 9, "assistant", "é." * 10)]
    rows += [(3004, 2, "user", "a."), (3004, 2, "user", "a."), (3004, 2, "assistant", "b."), (3004, None, "system", "s."), (3004, None, "system", "t.")]
    rows += [(3100 + c, 0, "user", "one.") for c in range(25)]  # some lose their only row
    rnd.shuffle(rows)
    assert found(spark, rows) == expected(rows)


def test_tree_of_several_levels(spark):
    """Blocks of one row make a tree of three levels; the result is that of one block."""
    rnd = random.Random(5)
    rows = conversation(rnd, 7, 400)
    table = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    own = spoiled(rows)[7]
    _, edits, fixed = repair.repair(table, block=1)
    got = "".join(r["audit"] for r in sorted(edits.collect(), key=lambda r: r["node"]))
    want = cheapest(own, faults_of(own))
    assert got == want[1] and sum(r["cost"] for r in edits.collect()) == want[0]
    assert [(r["role"], r["text"]) for r in fixed.orderBy("pos", "step").collect()] == list(want[2])


def test_no_rows(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.structure_repair(table).collect() == []
