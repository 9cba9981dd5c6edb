"""Conversation repair against trying all edits, and its damage and counts against a plain evaluation."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import conversation

PATTERN = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) by trying every edit of every row and up to two turns put in at every place."""
    faults, best = plain_faults(rows), None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults, strict=True)):
            continue
        for put_in in itertools.product(range(3), repeat=len(rows) + 1):
            letters = "".join("I" * n + e for n, e in zip(put_in, (*edits, ""), strict=True))
            cost = sum({"D": 4, "K": 0, "R": 3, "I": 3}[x] for x in letters) + sum(3 for e, f in zip(edits, faults, strict=True) if f == "truncated" and e != "D")
            if best and (cost, letters) >= best[:2]:
                continue
            steps = [(x, None) for n in put_in[:1] for x in "I" * n]
            for e, row, n in zip(edits, rows, put_in[1:], strict=True):
                steps += [(e, row), *[("I", None)] * n]
            for names in itertools.product(("user", "assistant"), repeat=sum(x in "RI" for x, _ in steps)):
                name, lines, initials = iter(names), [], ""
                for x, row in steps:
                    if x != "D":
                        role = row[1] if x == "K" else next(name)
                        lines.append(f"{role}:{row[2] if row else ''}")
                        initials += role[:1]
                if PATTERN.fullmatch(initials):
                    best = cost, letters, lines
                    break
    return best


def plain_audit(rows):
    """All columns of a conversation after damage but its id."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, turns = plain_faults(rows), [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, letters, lines = cheapest(rows) if rows else (0, "", [])
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_damage(rows):
    out = {}
    for own, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if own is None else own}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(own, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return out


def some_rows(seed, conversations=60, most=4):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, "u", ""], ["Hi.", "Well!", "so", " ", None, "a\nb?", "x. \t", "Hi."]
    return [(own, rng.choice([None, k, k, k, rng.randint(-2, 5)]), rng.choices(roles, (5, 5, 2, 1, 1, 1, 1))[0], rng.choice(texts)) for own in range(conversations) for k in range(rng.randint(1, most))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_trying_all_edits(spark, seed):
    rows = [*some_rows(seed), (None, 0, "user", "No id."), (None, 1, "assistant", "none")]
    random.Random(seed).shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA)
    found = {r["conv_id"]: tuple(r)[1:] for r in conversation.audit(conversation.damage(table)).collect()}
    assert found == {own: plain_audit(left) for own, left in plain_damage(rows).items()}


def test_dropped_conversations_and_clashing_columns(spark):
    dropped = [(k, 0, "user", "Hi.") for k in range(300) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    table = spark.createDataFrame(dropped, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "copy", "fault", "times", "kind", "a.b", "first")})
    found = conversation.audit(conversation.damage(table)).collect()
    assert len(found) == len(dropped) > 5
    assert {tuple(r)[1:] for r in found} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversation.audit(conversation.damage(table.limit(0))).count() == 0
    assert conversation.repair(conversation.damage(table)).count() == 0


def test_repaired_rows_make_the_digest(spark):
    rows = some_rows(7, 40)
    turns = conversation.as_turns(spark.createDataFrame(rows, SCHEMA))
    lines = {}
    for r in conversation.repair(turns).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["edit"]))
    for r in conversation.audit(turns).collect():
        own = lines.get(r["conv_id"], [])
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in own).encode()).hexdigest() == r["repaired_sha256"]
        assert "".join(e for *_, e in own) == r["audit"].replace("D", "") and PATTERN.fullmatch("".join(a[:1] for a, *_ in own))


def test_one_very_long_conversation(spark):
    """One conversation holds most rows, and says one line again and again."""
    n = 30_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") % 3 == 0, "Yes.").otherwise(F.concat(F.lit("Line "), F.col("id"), F.lit("."))).alias("text"))
    r = conversation.audit(conversation.as_turns(rows)).first()
    assert r["duplicate"] == n // 3 - 2 and r["gaps"] == 0 and r["illegal"] == 0 and len(r["audit"].replace("I", "")) == n
    assert r["cost"] == sum({"D": 4, "K": 0, "R": 3, "I": 3}[x] for x in r["audit"])
