"""Conversation repair against all edit sequences tried one by one, and on nulls, ties, repeats, long conversations."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, kind int, at long, key string, audit string, code string"
GOAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\f\r"


@pytest.fixture(scope="module", autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (fault != 0) + [(conv, turn, role, text)] * (fault == 3)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_edits(rows, found):
    """Every sequence of edits by dynamic programming over how the roles so far may go on: whole results, no matrices."""
    starts = {"": ["s", "u"], "s": ["u"], "u": ["a"], "a": ["u"]}
    best = {("", ""): (0, "", ())}  # (last initial or none) -> cheapest

    def offer(to, last, cost, audit, lines):
        if (last, "") not in to or (cost, audit) < to[last, ""][:2]:
            to[last, ""] = (cost, audit, lines)

    def inserts(states):
        for _ in range(4):
            for (last, _x), (cost, audit, lines) in list(states.items()):
                for r in starts[last]:
                    if r != "s":
                        offer(states, r, cost + 3, audit + "I", (*lines, ("user" if r == "u" else "assistant") + ":"))
        return states

    for (_, _, role, text), fault in zip(rows, found, strict=True):
        new = {}
        for (last, _x), (cost, audit, lines) in inserts(best).items():
            offer(new, last, cost + 4, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role[:1] in starts[last]:
                    offer(new, role[0], cost + extra, audit + "K", (*lines, f"{role}:{text}"))
                for r in starts[last]:
                    if r != "s":
                        offer(new, r, cost + 3 + extra, audit + "R", (*lines, f"{'user' if r == 'u' else 'assistant'}:{text}"))
        best = new
    return min(v for (last, _), v in inserts(best).items() if last in ("", "a"))


def plain(rows, conv, key=lambda r: (r[1] is not None, r[1] or 0)):
    mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (*key(r), r[2], hashlib.md5(f"{'-' if conv is None else conv}:{len(r[2].encode())}:{r[2]}:{r[3]}".encode()).digest()))
    found = faults(mine)
    turns = [r[1] for r in mine if r[1] is not None]
    cost, audit, lines = plain_edits(mine, found)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
    assert GOAL.fullmatch("".join(x[0] for x in lines))
    return (conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def rows_of(seed, long=300):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "why", "so it goes?  \n", "", "  ", None, "end ", "a. b", "Größe."]
    out = [(c, t, r.choices(roles, [9, 9, 3, 1, 1, 1, 1])[0], r.choice(texts)) for c in range(40) for t in sorted(r.choices(range(9), k=r.randrange(0, 8)))]
    out += [(100, t, ("user", "assistant")[t % 2] if r.random() < 0.9 else "system", f"turn {t}." if t % 7 else "again.") for t in range(long)]
    out += [(101, None, "user", "a."), (101, None, "assistant", "b."), (101, None, "user", "a."), (None, 1, "user", "x."), (None, None, "assistant", None), (102, None, None, None)]
    out += [(103, 5, "user", "same.")] * 50 + [(104, 1, "user", "x" * 200_000 + "."), (104, 2, "assistant", " " * 100_000 + "y")]
    r.shuffle(out)
    return out


def given_rows(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k", "KK", "u") for r in rows], SCHEMA).repartition(5)


def results(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_damage_and_repair(spark, seed):
    rows = rows_of(seed)
    turns = given_rows(spark, rows)
    hurt = plain_damage(rows)
    want = sorted((plain(hurt, c) for c in {r[0] for r in rows}), key=repr)
    assert results(repair.repair(repair.damaged(turns), turns)) == want
    assert sorted(map(repr, plain_damage(rows))) == sorted(repr(tuple(r)) for r in repair.damaged(turns).collect())


def test_without_damage_and_ids(spark):
    rows = [(c, t, "user" if x is None else x, "" if y is None else y) for c, t, x, y in rows_of(3, 40)]
    want = sorted((plain(rows, c) for c in {r[0] for r in rows}), key=repr)
    assert results(repair.repair(given_rows(spark, rows))) == want


def test_empty_and_all_dropped(spark):
    none = given_rows(spark, [(1, 1, "user", "x")]).filter("false")
    assert results(repair.repair(repair.damaged(none), none)) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    turns = given_rows(spark, [(7, gone, "user", "x.")])
    assert results(repair.repair(repair.damaged(turns), turns)) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_product_is_associative():
    r = random.Random(5)
    for _ in range(200):
        ms = [list(repair.turn_matrix(r.choice("suaxSUAX0123"))) for _ in range(r.randrange(1, 12))]
        left = ms[0]
        for m in ms[1:]:
            left = repair.product(left, m)
        k = r.randrange(1, len(ms)) if len(ms) > 1 else 0
        assert repair.tree(ms) == left and (not k or repair.product(repair.tree(ms[:k]), repair.tree(ms[k:])) == left)


def test_rounds(spark):
    """A long conversation needs several rounds; span and fan change nothing."""
    rows = [(c, t, ("user", "assistant", "user")[t % 3], f"{t}.") for c in (1, 2) for t in range(500 * (c == 1) + 3)]
    coded = repair.coded_turns(given_rows(spark, rows)).cache()
    a = repair.reduced(repair.segments(coded, 2), 2).orderBy("conv_id").select("conv_id", "costs", "audits", "illegal").collect()
    b = repair.reduced(repair.segments(coded, 64), 16).orderBy("conv_id").select("conv_id", "costs", "audits", "illegal").collect()
    assert a == b and len(a) == 2


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt = plain_damage(rows)
    assert results(repair.op13_conversation_repair(spark, d)) == sorted((plain(hurt, c) for c in {r[0] for r in rows}), key=repr)


def test_equal_keys_are_dealt_apart(spark):
    coded = repair.coded_turns(given_rows(spark, [(1, 1, "user", "same.")] * 4000))
    assert coded.select(F.shiftright("at", 33).alias("p")).distinct().count() > 1
    assert coded.agg(F.sum("duplicate")).first()[0] == 3999
