"""Conversation structure repair: the cheapest edits that give a conversation the roles `(s?(ua)+)?`.

Each turn is kept (K), gets another role (R) or is deleted (D); turns without text are inserted (I) before it or at the
end. A macro edit is a run of inserts and what becomes of the turn after it. As strings, macro edits are a prefix-free
code, so of two audits of equally many turns the ASCII-least is the one whose sequence of codes is least, and neither is a
prefix of the other. So the dynamic program over turns needs no strings: a state (nothing yet, s, u, a) has a cost, the
rank of its audit among the states of its layer, and a parent with the code that led from it; audits are read off
backward. Costs are relative to the least, so few different layers exist, and each is worked out once.

Turns are range-sorted over all partitions. A conversation may lie in several: for the part in each, the program is run
from every state that it may begin in, which gives a table of costs and ranks from state to state; tables of a
conversation, a few numbers each, are put together in order, and each part then reconstructs its own edits. So no task
holds a conversation; only the digest of its text is taken by one, that streams it.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import shard_count, written

#: What edits cost, and the states that a repaired conversation goes through.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
STATES, NEVER = range(4), 1 << 60
#: A state may be last if nothing or an assistant's turn is. A run of three inserts ends where one of them does.
MOST_INSERTS = 2
CODES = sorted("I" * n + edit for n in range(MOST_INSERTS + 1) for edit in "DKR")
#: Bytes of text that a range of turns has.
TASK_BYTES = 16 << 20
INK = r"[^\x20\x09-\x0D]"


def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = NEXT[state]
    return state


@lru_cache(None)
def moves(kind: tuple[str, str]) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, code) of the macro edits for a turn of this initial and fault."""
    initial, fault = kind
    found = []
    for code, text in enumerate(CODES):
        more = INSERT * (len(text) - 1)
        for state in STATES:
            at = _inserted(state, len(text) - 1)
            if text[-1] == "D":
                found.append((state, at, more + DELETE, code))
            elif fault in ("b", "d"):
                continue
            elif text[-1] == "R":
                found.append((state, NEXT[at], more + REROLE + TRUNCATED * (fault == "t"), code))
            elif initial == "s" and at == START or initial == ROLE[NEXT[at]][0]:
                found.append((state, SYSTEM if initial == "s" else NEXT[at], more + KEEP + TRUNCATED * (fault == "t"), code))
    return found


@lru_cache(100_000)
def step(layer: tuple, kind: tuple[str, str]) -> tuple[tuple, int, tuple]:
    """The layer after a turn: (cost above the least, rank) of each state, None where there is no way; the least cost;
    (parent, code) of each state."""
    best: dict[int, tuple] = {}
    for a, b, cost, code in moves(kind):
        if layer[a] is not None:
            found = (layer[a][0] + cost, layer[a][1], code, a)
            if b not in best or found < best[b]:
                best[b] = found
    least = min(x[0] for x in best.values())
    ranks = {b: rank for rank, b in enumerate(sorted(best, key=lambda b: best[b][1:3]))}
    return tuple((best[b][0] - least, ranks[b]) if b in best else None for b in STATES), least, tuple((best[b][3], best[b][2]) if b in best else None for b in STATES)


def only(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in STATES)


def forward(kinds: list, state: int) -> tuple[tuple, int, list]:
    """The last layer, the cost that its costs are above, and all layers' parents, of turns met in a state."""
    layer, total, parents = only(state), 0, []
    for kind in kinds:
        layer, least, parent = step(layer, kind)
        total += least
        parents.append(parent)
    return layer, total, parents


def edits(kinds: list, first: int, last: int) -> list[tuple[int, str, int]]:
    """(inserts before, edit, state after) of each turn, on the best way from a state to another."""
    out, state = [], last
    for parent in reversed(forward(kinds, first)[2]):
        before, code = parent[state]
        out.append((len(CODES[code]) - 1, CODES[code][-1], state))
        state = before
    return out[::-1]


def ended(layer: tuple, total: int) -> tuple[int, int, int]:
    """(cost, state, inserts) of the best end: a turn of an assistant, or nothing."""
    found = []
    for state in STATES:
        for n in range(MOST_INSERTS + 1):
            if layer[state] is not None and _inserted(state, n) in (START, ASSISTANT):
                found.append((total + layer[state][0] + INSERT * n, layer[state][1], n, state))
    cost, _, n, state = min(found)
    return cost, state, n


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with every 20th turn lost, emptied, cut short, repeated or given to the user, by a hash
    of conversation and turn. Nulls of roles and texts become a blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hurt = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), hurt.alias("__hurt")).where("__hurt <> 0")
    text = F.when(F.col("__hurt") == 1, "").when(F.col("__hurt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    again = F.when(F.col("__hurt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("__again", F.explode(again))
    return rows.select("conv_id", "turn", F.when(F.col("__hurt") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with `pos`, their place in the order of conversations and turns; its high bits are the range, `part`."""
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(shard_count(rows, "text", TASK_BYTES), *order, F.rand(13)).sortWithinPartitions(*order)
    pos = F.monotonically_increasing_id()
    return written(ranged.select("*", pos.alias("pos"), F.spark_partition_id().alias("part")), "turns")


def _kinds(placed: DataFrame) -> DataFrame:
    """conv_id, part, pos, initial (of the role; other than s, u, a: o) and fault (b, d, t or nothing) of each row."""
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    keyed = placed.select("conv_id", "part", "pos", F.substring("role", 1, 1).alias("i"), key.alias("key"), (~F.col("text").rlike(INK)).alias("blank"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("whole"))
    keyed = written(keyed, "turn-keys")
    first = keyed.groupBy("conv_id", "key").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(~F.col("whole"), "t").otherwise("")
    initial = F.when(F.col("i").isin("s", "u", "a"), F.col("i")).otherwise("o")
    return written(keyed.join(first, "pos", "left").select("conv_id", "part", "pos", initial.alias("initial"), fault.alias("fault")), "turn-kinds")


def _runs(batches, columns: list[str]):
    """(conv_id, part, the columns' lists) of each run of rows of one conversation in a range."""
    rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("conv_id", "part", *columns))))
    for (conv, part), group in itertools.groupby(rows, key=lambda r: r[:2]):
        yield conv, part, *map(list, zip(*(r[2:] for r in group)))


def _emitted(rows, schema: pa.Schema, most: int = 4096):
    """Tuples as batches."""
    rows = iter(rows)
    while some := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def _schema(kind, *fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("conv_id", to_arrow_type(kind)), *fields])


#: From each state to each: cost, then rank; -1 where there is no way.
TABLE = ("table", pa.list_(pa.int64()))
COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = {"su", "ua", "au"}


def _by_part(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", *order)


def _tables(kinds: DataFrame) -> DataFrame:
    """For the part of each conversation in each range: its table, first and last initial, counts of faults."""
    kind = kinds.schema["conv_id"].dataType
    schema = _schema(kind, ("part", pa.int32()), TABLE, ("ends", pa.string()), *((c, pa.int64()) for c in COUNTS))

    def found(batches):
        for conv, part, initials, faults in _runs(batches, ["initial", "fault"]):
            turns, table = list(zip(initials, faults)), []
            for state in STATES:
                layer, total, _ = forward(turns, state)
                for x in layer:
                    table += (-1, -1) if x is None else (total + x[0], x[1])
            yield conv, part, table, initials[0] + initials[-1], *(faults.count(f) for f in "bdt"), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))

    ddl = f"conv_id {kind.simpleString()}, part int, table array<long>, ends string, blank long, duplicate long, truncated long, illegal long"
    return _by_part(kinds, "pos").mapInArrow(lambda b: _emitted(found(b), schema), ddl)


def _joined(tables: list[list[int]]) -> tuple[int, list[tuple[int, int]], int]:
    """(cost, first and last state in each part, inserts at the end) of a conversation whose parts have these tables."""
    layer, parents = only(START), []
    for table in tables:
        best: dict[int, tuple] = {}
        for a, b in itertools.product(STATES, STATES):
            cost, rank = table[8 * a + 2 * b : 8 * a + 2 * b + 2]
            if layer[a] is not None and cost >= 0:
                found = (layer[a][0] + cost, layer[a][1], rank, a)
                if b not in best or found < best[b]:
                    best[b] = found
        ranks = {b: rank for rank, b in enumerate(sorted(best, key=lambda b: best[b][1:3]))}
        layer = tuple((best[b][0], ranks[b]) if b in best else None for b in STATES)
        parents.append(tuple(best[b][3] if b in best else None for b in STATES))
    cost, state, n = ended(layer, 0)
    ways = []
    for parent in reversed(parents):
        ways.append((parent[state], state))
        state = parent[state]
    return cost, ways[::-1], n


def _ways(tables: DataFrame) -> DataFrame:
    """For each part of each conversation: the states that its first turn is met in and its last one leaves; its last part
    has the inserts at the end, cost and counts too. What meets in a task is a few numbers for each part."""
    kind = tables.schema["conv_id"].dataType
    schema = _schema(kind, ("part", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("inserts", pa.int32()), ("cost", pa.int64()), *((c, pa.int64()) for c in COUNTS))

    def found(batches):
        columns = ["part", "table", "ends", *COUNTS]
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("conv_id", *columns))))
        for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
            _, parts, tables, ends, *counts = zip(*group)
            cost, ways, inserts = _joined(tables)
            totals = [sum(c) for c in counts]
            totals[3] += sum(a[1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:]))
            for nth, (part, way) in enumerate(zip(parts, ways), 1):
                yield conv, part, *way, *((inserts, cost, *totals) if nth == len(parts) else [None] * 6)

    ddl = f"conv_id {kind.simpleString()}, part int, first int, last int, inserts int, cost long, blank long, duplicate long, truncated long, illegal long"
    return tables.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(lambda b: _emitted(found(b), schema), ddl)


def _edits(kinds: DataFrame, ways: DataFrame) -> DataFrame:
    """conv_id, pos, inserts (roles before), edit, role (that it gets, if another)."""
    kind = kinds.schema["conv_id"].dataType
    schema = _schema(kind, ("pos", pa.int64()), ("inserts", pa.string()), ("edit", pa.string()))

    def found(batches):
        # a part's way comes before its turns
        for conv, _, pos, initial, fault, first, last in _runs(batches, ["pos", "initial", "fault", "first", "last"]):
            state = first[0]
            for at, (n, edit, after) in zip(pos[1:], edits(list(zip(initial[1:], fault[1:])), first[0], last[0])):
                roles = "".join(ROLE[_inserted(state, i + 1)][0] for i in range(n))
                yield conv, at, roles, edit if edit != "R" else "R" + ROLE[after][0]
                state = after

    begin = ways.select("conv_id", "part", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("initial"), F.lit("").alias("fault"), "first", "last")
    rows = kinds.withColumns({"first": F.lit(None).cast("int"), "last": F.lit(None).cast("int")}).unionByName(begin)
    return _by_part(rows, "conv_id", "pos").mapInArrow(lambda b: _emitted(found(b), schema), f"conv_id {kind.simpleString()}, pos long, inserts string, edit string")


def _digests(placed: DataFrame, edits: DataFrame, ends: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256: turns meet their edits in a stream, sorted by conversation and place."""
    kind = placed.schema["conv_id"].dataType
    schema = _schema(kind, ("audit", pa.string()), ("repaired_sha256", pa.string()))
    role = {v[0]: v for v in ROLE.values()}

    def found(batches):
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("conv_id", "nth", "inserts", "edit", "role")), b["text"]))
        for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
            audit, digest, some, edit = [], hashlib.sha256(), False, ""

            def add(role: str, text: str) -> None:
                nonlocal some
                digest.update(("\n" * some + role + ":" + text).encode())
                some = True

            for _, nth, inserts, what, own, text in group:
                if nth != 1:  # an edit, or the end
                    edit = what or ""
                    for r in inserts:
                        add(role[r], "")
                    audit.append("I" * len(inserts) + edit[:1])
                elif edit != "D":
                    add(role[edit[1]] if edit[0] == "R" else own, text.as_py())
            yield conv, "".join(audit), digest.hexdigest()

    none = F.lit(None).cast("string")
    after = F.when(F.col("last") == USER, "a").when(F.col("inserts") > 0, F.substring(F.lit("ua"), 1, F.col("inserts"))).otherwise("")
    rows = edits.select("conv_id", "pos", F.lit(0).alias("nth"), "inserts", "edit", none.alias("role"), none.alias("text"))
    rows = rows.unionByName(placed.select("conv_id", "pos", F.lit(1).alias("nth"), none.alias("inserts"), none.alias("edit"), "role", "text"))
    rows = rows.unionByName(ends.select("conv_id", F.lit((1 << 63) - 1).alias("pos"), F.lit(2).alias("nth"), F.when(F.col("inserts") > 0, after).otherwise("").alias("inserts"), none.alias("edit"), none.alias("role"), none.alias("text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "nth").mapInArrow(lambda b: _emitted(found(b), schema, 256), f"conv_id {kind.simpleString()}, audit string, repaired_sha256 string")


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 for every conv_id of conversations.

    Rows are ordered by turn, those without one first; of one turn by role and text. A row's first fault counts: it has
    no ink, its role and text were seen before in the conversation (compared by MD5), its last ink isn't a stop. Roles
    count by their first letter; others than s, u and a can't be kept. Rows without a conv_id are one conversation.
    Conversations without rows have zeros and the digest of nothing; an empty table gives none. gaps is null where a long
    doesn't hold it.
    """
    placed = _placed(rows.select("conv_id", "turn", "role", "text"))
    kinds = _kinds(placed)
    ways = written(_ways(_tables(kinds)), "ways")
    ends = ways.where("cost is not null")
    digests = _digests(placed, _edits(kinds, ways), ends)
    turns = placed.groupBy("conv_id", "turn").agg(F.lit(1).alias("x")).groupBy("conv_id").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count("turn").alias("n"))
    gaps = turns.select("conv_id", F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.expr("try_cast(cast(most as decimal(20,0)) - cast(least as decimal(20,0)) + 1 - n as bigint)")).alias("gaps"), F.lit(True).alias("has"))
    every = conversations.select("conv_id").distinct()
    for nth, part in enumerate((gaps, ends.select("conv_id", "cost", *COUNTS), digests)):
        part = part.withColumnRenamed("conv_id", f"__{nth}")
        every = every.join(part, F.col("conv_id").eqNullSafe(F.col(f"__{nth}")), "left").drop(f"__{nth}")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.select("conv_id", F.when(F.col("has"), F.col("gaps")).otherwise(F.lit(0).cast("long")).alias("gaps"), *map(zero, (*COUNTS, "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text; other columns are ignored), damaged and repaired (see damaged, repair)."""
    return repair(damaged(conversations), conversations)
