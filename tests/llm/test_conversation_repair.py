"""Conversation repair against a search over whole strings, from the last turn to the first."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from codeloom.llm import conversation_repair, queries

AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\v\f\r"


def cheapest(turns):
    """(cost, audit, repaired turns) of (role, text, fault) turns."""

    @functools.cache
    def best(i, state, inserts):
        found = []
        if i == len(turns) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 4:
            to = AFTER[state]
            c, a, r = best(i, to, inserts + 1)
            found.append((c + 5, "I" + a, ((NAMES[to], ""), *r)))
        if i < len(turns):
            role, text, fault = turns[i]
            c, a, r = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                more, to = 5 * (fault == "truncated"), AFTER[state]
                c, a, r = best(i + 1, to, 0)
                found.append((c + more + 1, "R" + a, ((NAMES[to], text), *r)))
                keeps = "s" if role[:1] == "s" and state == "" else to if role[:1] == to else None
                if keeps:
                    c, a, r = best(i + 1, keeps, 0)
                    found.append((c + more, "K" + a, ((role, text), *r)))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    for i in range(len(turns), -1, -1):  # so that recursion stays shallow
        for state in AFTER:
            best(i, state, 0)
    return best(0, "", 0)


def by_hand(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        crc = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if crc == 1 else re.sub("[.!?]", "", text) if crc == 2 else text
        convs[conv] += [(turn, "user" if crc == 4 else role, text)] * (0 if crc == 0 else 2 if crc == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, judged, count = set(), [], collections.Counter()
        for _, role, text in turns:
            ink = text.strip(SPACE)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            judged.append((role, text, fault))
        numbers = {t[0] for t in turns if t[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, repaired = cheapest(judged)
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def same(found, rows):
    got = {r[0]: tuple(r)[1:] for r in found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    expected = by_hand(rows)
    assert got.keys() == expected.keys()
    for conv, row in expected.items():
        assert got[conv] == row, conv


def made(rng, n):
    roles = rng.choices(["user", "assistant", "system", "tool", None, "", "a", "sys"], weights=[9, 9, 4, 1, 1, 1, 1, 1], k=n)
    texts = rng.choices(["Yes.", "No!", "one two", "", " \n", None, "Why?\t ", "End.\x0b", "x", "é.", "a.b", "Long " * 50 + "."], k=n)
    return [(rng.choice([None, *range(-2, 12)]) if rng.random() < 0.3 else i, r, t) for i, (r, t) in enumerate(zip(roles, texts))]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(conv, *turn) for conv in range(300) for turn in made(rng, rng.randrange(1, 12))]
    out += [(None, *turn) for turn in made(rng, 30)] + [(1000, None, "user", "Null turns."), (1000, None, "assistant", "Yes.")]
    return out + out[:20]


def test_against_search(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("pos", "part", "first", "cost", "nth", "has")}).repartition(5)
    same(conversation_repair.damage_and_repair(table), rows)


def test_conversation_over_many_ranges(spark):
    """One conversation of a third of all rows, half of them alike, is put together from its parts."""
    rng = random.Random(9)
    large = [(7, i, *turn[1:]) for i, turn in enumerate(made(rng, 700))] + [(7, 701, "user", "Again.")] * 300
    rows = large + [(conv, *turn) for conv in range(10, 400) for turn in made(rng, 5)]
    conversation_repair.TASK_BYTES, before = 600, conversation_repair.TASK_BYTES
    placed = conversation_repair._placed(conversation_repair.damaged(spark.createDataFrame(rows, SCHEMA)))
    per = [r["count"] for r in placed.where("conv_id = 7").groupBy("part").count().collect()]
    assert len(per) > 20 and max(per) < 300
    same(conversation_repair.damage_and_repair(spark.createDataFrame(rows, SCHEMA)), rows)
    conversation_repair.TASK_BYTES = before


def test_edges(spark):
    """Turns all lost, extremes of turns, no table at all, ids of another type."""
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Lost."), (5000, -(1 << 62), "user", "Far."), (5000, 1 << 62, "assistant", "Away.")]
    found = {r.conv_id: r for r in conversation_repair.damage_and_repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert tuple(found[lost])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[5000].gaps == (1 << 63) - 1
    assert conversation_repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_repair.damage_and_repair(spark.createDataFrame([("x", 1, "user", "Ha.")], SCHEMA.replace("long", "string", 1))).first().conv_id == "x"


def test_registered_query(spark):
    at = "/root/testdata/sf0.001"
    same(queries.op13_conversation_repair(spark, at), [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_sql(rows):
    """The SQL of the registered query, on the same odd rows."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.sql(queries.ORACLE_SQL["op13_conversation_repair"]).fetchall()} == by_hand(rows)
