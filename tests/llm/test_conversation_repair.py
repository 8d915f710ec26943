"""Conversation repair against all edits of short words, and against a plain search over rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from gridspark.llm import conversation_repair as cr
from tests.llm.helpers import prose

SCHEMA = "conv_id long, turn long, role string, text string, conv string, h1 string, found string, times string, part int, symbol int"
CLASSES = "suax"


def all_edits(word: bytes) -> tuple[int, str]:
    """Cheapest cost and ASCII-least audit over every way to edit, two insertions in a row at most."""
    gaps = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    best = None
    rows = []
    for symbol in word:
        kind, role = symbol % 4, CLASSES[symbol // 4]
        rows.append([("D", "", 3)] + ([("K", role, kind), ("R", "u", 2 + kind), ("R", "a", 2 + kind)] if kind < 2 else []))
    for edits in itertools.product(*rows):
        for puts in itertools.product(gaps, repeat=len(word) + 1):
            roles = "".join("".join(p) + e[1] for p, e in zip(puts, [*edits, ("", "", 0)]))
            cost = sum(e[2] for e in edits) + 2 * sum(map(len, puts))
            if (best is None or cost <= best[0]) and re.fullmatch("(s?(ua)+)?", roles):
                audit = "".join("I" * len(p) + e[0] for p, e in zip(puts, [*edits, ("", "", 0)]))
                best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("n", [0, 1, 2])
def test_every_short_word(n):
    repairs = cr.Repairs()
    for word in itertools.product(range(16), repeat=n):
        assert repairs.repair(bytes(word)) == all_edits(bytes(word)), word


def least(rows: list[tuple[str, str, int]]) -> tuple[int, str, str]:
    """(cost, audit, repaired text) by the least of each of four places, nothing dropped; rows: role, text, kind."""
    after, name = (2, 2, 3, 2), ("user", "user", "assistant", "user")
    never = (10**9, "", ())

    def insert(v):
        for _ in range(4):
            for p in range(4):
                v[after[p]] = min(v[after[p]], (v[p][0] + 2, v[p][1] + "I", (*v[p][2], name[p] + ":")))
        return v

    v = insert([(0, "", ()), never, never, never])
    for role, text, kind in rows:
        w = [(c + 3, a + "D", t) for c, a, t in v]
        for p, (c, a, t) in enumerate(v):
            if kind < 2:
                w[after[p]] = min(w[after[p]], (c + 2 + kind, a + "R", (*t, f"{name[p]}:{text}")))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], p))
                if to:
                    w[to] = min(w[to], (c + kind, a + "K", (*t, f"{role}:{text}")))
        v = insert(w)
    cost, audit, lines = min(v[0], v[3])
    return cost, audit, "\n".join(lines)


def test_long_words_equal_a_plain_search():
    rng, repairs = random.Random(3), cr.Repairs()
    for n in [*range(3, 40), 200]:
        for weights in ([1] * 16, [9, 2, 1, 1] * 3 + [0] * 4, [5, 1, 0, 0] + [1] * 12):
            word = bytes(rng.choices(range(16), weights, k=n))
            assert repairs.repair(word) == least([(CLASSES[s // 4], "", s % 4) for s in word])[:2]
    assert len(repairs.vectors) < 200


def conversations() -> list[tuple]:
    rng, rows = random.Random(8), []
    for conv in range(60):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            rows.append((conv if conv else None, turn if rng.random() < 0.9 else None, role, rng.choice(["Yes.", "no", prose(turn, 5) + "!", " \t\n", "", None, "wait... what? \n", "é。", prose(9, 3)])))
    rows += [(7, 3, "user", "Same turn."), (7, 3, "user", "Another."), (7, 3, "assistant", "Third."), (7, 3, "user", "Same turn.")]
    rows += [(99, k, "user" if k % 2 else "assistant", f"{prose(k % 50, 4)}.") for k in range(3000)] + [(100, 0, "user", prose(1, 20_000))]
    return rows


def text(x) -> str:
    return " " if x is None else str(x)


def damaged(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, said in rows:
        kept, z = out.setdefault(conv, []), zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, said = "user" if z == 4 else text(role), "" if z == 1 else re.sub("[.!?]", "", text(said)) if z == 2 else text(said)
        kept += [(turn, role, said)] * (0 if z == 0 else 2 if z == 3 else 1)
    return out


def test_equals_a_plain_search_over_rows(spark):
    rows = conversations()
    frame = cr.damage(spark.createDataFrame([(*r, "a", "b", "c", "d", 1, 2) for r in rows], SCHEMA).repartition(7))
    found = cr.summarise(frame).cache()
    got = {r["conv"]: r for r in cr.digests(frame, found).collect()}
    steps: dict = {}
    for r in sorted(cr.repaired(frame, found).collect(), key=lambda r: (r["conv"] is None, r["conv"] or 0, r["step"])):
        assert r["step"] == len(steps.setdefault(r["conv"], []))
        steps[r["conv"]].append((r["edit"], f"{r['role']}:{r['text']}"))
    expected = damaged(rows)
    assert set(got) == set(expected)
    hashes = {(r["role"], r["text"]): (r["h1"], r["h2"]) for r in cr._prepared(frame).collect()}
    for conv, kept in expected.items():
        kept = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashes[r[1:]]))
        seen, faults = set(), []
        for _, role, said in kept:
            bare = said.strip(" \t\n\v\f\r")
            kind = 2 if not bare else 3 if (role, said) in seen else 1 if bare[-1] not in ".!?" else 0
            seen.add((role, said))
            faults.append((role, said, kind))
        cost, audit, body = least(faults)
        r, turns = got[conv], {t for t, *_ in kept if t is not None}
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256(body.encode()).hexdigest()), conv
        assert [r["blank"], r["duplicate"], r["truncated"]] == [sum(f[2] == k for f in faults) for k in (2, 3, 1)]
        assert r["illegal"] == sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(faults, faults[1:]))
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert "\n".join(line for _, line in steps.get(conv, [])) == body
        assert "".join(e for e, _ in steps.get(conv, [])) == audit.replace("D", "")


def test_no_rows(spark):
    frame = cr.damage(spark.createDataFrame([], SCHEMA))
    found = cr.summarise(frame)
    assert found.count() == cr.digests(frame, found).count() == cr.repaired(frame, found).count() == 0
