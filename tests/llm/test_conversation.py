"""Conversation repair against a brute-force version: exhaustive search over edits, row by row."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from codeloom.llm import conversation

SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, kind string, at string, row string, signature string"


def made(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA)


def cheapest(rows):
    """(cost, audit, repaired) of (role, text, must go, truncated) rows, by relaxing whole edit strings."""
    best = {(0, ""): (0, "", ())}  # place, roles so far -> cost, audit, rows
    todo = [(0, 0, "", "", ())]
    answer = None
    while todo:
        todo.sort(key=lambda x: (x[0], x[3]))
        cost, at, roles, audit, out = todo.pop(0)
        if answer and cost > answer[0]:
            break
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (answer is None or (cost, audit) < answer[:2]):
            answer = (cost, audit, out)
        steps = [(5, at, "u", "I", (("user", ""),)), (5, at, "a", "I", (("assistant", ""),))] if audit.count("I") < 6 else []
        if at < len(rows):
            role, text, gone, cut = rows[at]
            steps.append((2, at + 1, "", "D", ()))
            if not gone:
                more = 5 if cut else 0
                steps += [(more, at + 1, role[:1] or " ", "K", ((role, text),)), (1 + more, at + 1, "u", "R", (("user", text),)), (1 + more, at + 1, "a", "R", (("assistant", text),))]
        for c, place, initial, letter, row in steps:
            whole = roles + initial
            if re.fullmatch("s?(ua)*u?", whole):
                state = (place, whole[-1:])  # what follows depends on this alone
                new = (cost + c, audit + letter, out + row)
                if state not in best or new[:2] < best[state][:2]:
                    best[state] = new
                    todo.append((new[0], place, whole, new[1], new[2]))
    return answer


def brute(rows):
    by = defaultdict(list)
    ids = {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        by[conv] += [] if hit == 0 else [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    result = {}
    for conv in ids:
        own = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            kind = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if kind:
                counts[kind] += 1
            marked.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] or " ") + (b[1][:1] or " ") not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, out = cheapest(marked)
        result[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    return result


def got(frame):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in frame.collect()}


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "usher", ""]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Same. ", "Ä?\n", "a:b."]
    rows = []
    for conv in [None, *range(convs)]:
        for _ in range(rng.randrange(1, most)):
            rows.append((conv, rng.choice([None, *range(-2, 30)]), rng.choice(roles), rng.choice([*texts, f"t{rng.random()}."])))
    return rows


@pytest.mark.parametrize(("piece", "block"), [(4096, 512), (2, 1), (3, 2)])
def test_equals_brute_force(spark, monkeypatch, piece, block):
    monkeypatch.setattr(conversation, "PIECE", piece)
    monkeypatch.setattr(conversation, "BLOCK", block)
    rows = random_rows(piece, 25, 9)
    rows += rows[:10]  # repeated rows
    assert got(conversation.structure(made(spark, rows))) == brute(rows)


def test_prices_are_the_cost_of_the_cheapest_way():
    rng = random.Random(5)
    for _ in range(60):
        signature = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(7)))
        roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
        rows = [(roles[c.lower()], "", c == "x", c.isupper()) for c in signature]
        assert conversation.repair(signature) == cheapest(rows)[:2][::-1]


def test_blocks_do_not_change_the_answer(monkeypatch):
    rng = random.Random(9)
    signatures = ["".join(rng.choice("suaoSUAOxuaua") for _ in range(400)) for _ in range(5)]
    whole = [conversation.repair(s) for s in signatures]
    monkeypatch.setattr(conversation, "BLOCK", 7)
    assert [conversation.repair(s) for s in signatures] == whole


def test_unreachable_ends_have_no_price():
    assert conversation.auction("uo", (0, conversation.FAR, conversation.FAR, conversation.FAR))[0] == [4, *[conversation.FAR] * 3]


def test_long_conversation_and_long_text(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"word{k}. " * 40) for k in range(9000)] + [(2, 1, "user", "x" * 300_000 + ".")]
    found = got(conversation.structure(made(spark, rows)))
    assert len(found[1][6]) > 8000 and set(found[1][6]) <= set("DIKR")
    assert found[2][5] in (0, 2, 4)  # nobody answers: dropped, or each copy deleted


def test_empty_table(spark):
    frame = conversation.structure(made(spark, []))
    assert frame.count() == 0
    assert frame.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_dropped_conversation_stays_with_zeros(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(conversation.structure(made(spark, [(conv, 0, "user", "Hi.")]))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
