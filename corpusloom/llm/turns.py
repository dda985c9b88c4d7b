"""Repair of the structure of conversations: the cheapest edits that make roles alternate, with an audit of them.

A conversation is right when its roles are an optional system turn and then pairs of user and assistant. Which turns to keep or to give
another role is a shortest path over the retained ones: what lies between two of them is deleted (a difference of prefix sums), and
their roles determine what must be inserted, so that a running minimum per role of the next retained turn prices all gaps in linear
time. Of equally cheap edits, those whose audit comes first in ASCII order are taken.

Rows are sorted into ranges of (conversation, place), so a conversation of any size is spread over tasks: each range yields a byte a
row and, where a conversation may go on beyond it, its costs from each state to each state. These few matrices are chained per
conversation, and ranges then write their parts of the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from corpusloom.llm.common import scratch

# Costs of edits, what a blank is made of, and the ends of a sentence.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

#: States are the last retained role: nothing yet, system, user, assistant; rows have these roles, 0 for any other. Faults are 0 none,
#: 1 truncated, 2 blank, 3 duplicate; a row's byte is 4 * fault + role.
SYSTEM, USER, ASSISTANT = 1, 2, 3
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
NEXT = (USER, USER, ASSISTANT, USER)
#: Turns to insert between a state and a retained role, and between a state and the end.
GAP = {USER: (0, 0, 1, 0), ASSISTANT: (1, 1, 0, 1)}
LAST = (0, 2, 1, 0)
FAR = 1 << 60
#: Cost from each state when nothing follows.
END = tuple(INSERT * n for n in LAST)


def plan(codes: bytes, end: tuple) -> tuple[list[int], list[bytearray]]:
    """Cost of the cheapest edits of rows from each state, if `end` is the cost of each state after them; and the choice at each row and
    state: 0 deletes, else 2 * role + (1 if it is kept)."""
    n = len(codes)
    choices = [bytearray(n) for _ in range(4)]
    cost = list(end)  # from each state, before row i
    # gone[s]: no further row is retained. best[r]: the next retained row has role r; both as of row 0, less what was deleted before i.
    gone = [c + DELETE * n for c in end]
    best = {SYSTEM: FAR, USER: FAR, ASSISTANT: FAR}
    for i in range(n - 1, -1, -1):
        fault, role = codes[i] >> 2, codes[i] & 3
        here = {}
        if fault < 2:
            more = DELETE * i + (TRUNCATED if fault else 0)
            for r in (USER, ASSISTANT):
                here[r] = (cost[r] + more + (0 if r == role else REROLE), r == role)
            if role == SYSTEM:
                here[SYSTEM] = (cost[SYSTEM] + more, True)
        after, least = cost, DELETE * i
        cost = []
        for s in range(4):
            found = min(gone[s], best[USER] + INSERT * GAP[USER][s], best[ASSISTANT] + INSERT * GAP[ASSISTANT][s], best[SYSTEM] if s == 0 else FAR)
            pick = None  # found is the cost of deleting row i
            for r, (c, kept) in here.items():
                if r == SYSTEM and s:
                    continue
                gap = 0 if r == SYSTEM else GAP[r][s]
                c += INSERT * gap
                audit = "I" * gap + ("K" if kept else "R")
                if c < found or (c == found and pick and audit < pick[0]):
                    found, pick = c, (audit, 2 * r + kept)
            if pick:
                choices[s][i] = pick[1]
            cost.append(min(found - least, FAR))
        for r, (c, _) in here.items():
            best[r] = min(best[r], c)
    return cost, choices


def walk(choices: list[bytearray], state: int) -> tuple[str, int]:
    """Audit of the choices from a state, and the state after them."""
    out = []
    for i in range(len(choices[0])):
        c = choices[state][i]
        if not c:
            out.append("D")
            continue
        role = c >> 1
        out.append(("I" if role != SYSTEM and GAP[role][state] else "") + ("K" if c & 1 else "R"))
        state = role
    return "".join(out), state


def matrix(codes: bytes) -> list[int]:
    """Costs from each state to each state, row by row."""
    columns = [plan(codes, tuple(0 if s == e else FAR for s in range(4)))[0] for e in range(4)]
    return [columns[e][s] for s in range(4) for e in range(4)]


def illegal(codes: bytes) -> int:
    """Adjacent roles that are none of system-user, user-assistant and assistant-user."""
    legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    return sum((a & 3, b & 3) not in legal for a, b in zip(codes, codes[1:]))


def _ordered(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, digest: nulls are one space. Places in a conversation follow turn (nulls first), role and digest."""
    blank = F.lit(" ")
    out = rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text"))
    return out.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)))


PLACE = ("conv", "turn", "role", "digest")


def _with(rows: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """rows joined with what was found of their conversations, and of their digests or parts."""
    key = next(c for c in ("digest", "part") if c in found.columns)
    found = found.withColumnsRenamed({"conv": "_conv", key: "_key"})
    return rows.join(found, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col(key) == F.col("_key")), how).drop("_conv", "_key")


def _later(rows: DataFrame) -> DataFrame:
    """rows with `later`: whether an earlier turn of the conversation has the same role and text. Of what is repeated, that which has
    more than a thousandth of the repeated rows is at most a thousand keys, so it is broadcast; the rest is joined by a shuffle."""
    at = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    repeated = rows.groupBy("conv", "digest").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.count("*").alias("_n"))
    repeated = scratch(repeated.where("_first <> _last").drop("_last"), "repeated")
    total = repeated.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    marked = _with(rows, F.broadcast(repeated.where(F.col("_n") * 1000 > total).drop("_n")))
    later = F.coalesce(at > F.col("_first"), F.lit(False)).alias("later")
    seldom = _with(marked.where("_first is null").drop("_first"), repeated.where(F.col("_n") * 1000 <= total).drop("_n"))
    return marked.where("_first is not null").unionByName(seldom).select(*rows.columns, later)


RANGE = "part int, open boolean, codes binary, costs array<long>, first long, last long, turns long"


def _typed(schema: str, conv) -> StructType:
    """A schema with the conversation's id, whatever its type, before other fields."""
    return StructType([StructField("conv", conv), *StructType.fromDDL(schema).fields])


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)


def _ranges(rows: DataFrame) -> DataFrame:
    """RANGE: one row per conversation and range of rows; open ones may go on in another range and have costs."""
    body = F.rtrim("text", F.lit(BLANK))
    fault = F.when(body == "", 2).when(~F.substring(body, -1, 1).isin(*ENDS), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    features = _later(rows.select(*PLACE, (fault * 4 + code).cast("int").alias("code")))
    schema = _typed(RANGE, rows.schema["conv"].dataType)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, now, before = TaskContext.get().partitionId(), [], None, None
        closed = lambda is_open: (now[0], part, is_open, bytes(now[1]), matrix(now[1]) if is_open else None, *now[2:])
        first = True
        for batch in batches:
            for conv, turn, digest, code, later in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn", "digest", "code", "later"))):
                if now is None or conv != now[0]:
                    if now is not None:
                        held.append(closed(first))
                        first = False
                    now, before = [conv, bytearray(), None, None, 0], None
                if code >> 2 != 2 and (later or before == (turn, digest)):
                    code = 12 + (code & 3)
                before = turn, digest
                now[1].append(code)
                if turn is not None and turn != now[3]:
                    now[2:] = [turn if now[2] is None else now[2], turn, now[4] + 1]
            if len(held) >= 1000:
                yield _batch(held, schema)
                held = []
        if now is not None:
            yield _batch([*held, closed(True)], schema)

    return features.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(gather, schema)


PART = "part int, open boolean, cost long, audits array<string>, states array<int>, blank long, duplicate long, truncated long, illegal long, head int, tail int, first long, last long, turns long"
PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _grouped(rows: DataFrame, work, schema: StructType) -> DataFrame:
    """work(list of a conversation's rows by part) for each conversation."""

    def run(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(work(sorted(group.to_pylist(), key=lambda r: r["part"])), schema)])

    return rows.groupBy("conv").applyInArrow(run, schema)


def _following(parts: list[dict]) -> list[tuple]:
    """Costs from each state after each part of a conversation."""
    out, end = [], list(END)
    for p in reversed(parts):
        out.append((p["conv"], p["part"], end))
        end = [min(p["costs"][4 * s + e] + end[e] for e in range(4)) for s in range(4)]
    return out


def _chained(parts: list[dict]) -> list[tuple]:
    """The plan of a conversation from its parts, in their order."""
    state, audit, illegal_pairs, turns, before = 0, [], 0, 0, None
    for p in parts:
        audit.append(p["audits"][state])
        state = p["states"][state]
        illegal_pairs += p["illegal"] + (before is not None and illegal(bytes([before["tail"], p["head"]])))
        before = p
    audit.append("I" * LAST[state])
    timed = [p for p in parts if p["turns"]]
    turns = sum(p["turns"] for p in timed) - sum(a["last"] == b["first"] for a, b in zip(timed, timed[1:]))
    gaps = timed[-1]["last"] - timed[0]["first"] + 1 - turns if timed else 0
    return [(parts[0]["conv"], gaps, *(sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated")), illegal_pairs, parts[0]["cost"], "".join(audit))]


def plans(rows: DataFrame) -> DataFrame:
    """conv and PLAN of the conversations of _ordered() rows."""
    conv = rows.schema["conv"].dataType
    ranges = scratch(_ranges(rows), "ranges")
    following = _grouped(ranges.where("open").select("conv", "part", "costs"), _following, _typed("part int, end array<long>", conv))
    ranges = _with(ranges.drop("costs"), F.broadcast(following))  # at most two for each range
    schema, done = _typed(PART, conv), _typed(PLAN, conv)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                codes = r["codes"]
                cost, choices = plan(codes, tuple(r["end"] or END))
                walks = [walk(choices, s) for s in (range(4) if r["open"] else (0,))]
                faults = [sum(c >> 2 == k for c in codes) for k in (2, 3, 1)]
                out.append((r["conv"], r["part"], r["open"], cost[0], [a for a, _ in walks], [s for _, s in walks], *faults, illegal(codes), codes[0], codes[-1], r["first"], r["last"], r["turns"]))
            yield _batch(out, schema)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([x for r in batch.to_pylist() for x in _chained([r])], done)

    parts = scratch(ranges.mapInArrow(decide, schema), "parts")
    return parts.where("not open").mapInArrow(alone, done).unionByName(_grouped(parts.where("open"), _chained, done))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Plans and rows of conversations, each after its plan: (conv, None, plan, None) for a plan, else (conv, edit, role, text) for each
    edit. Holds a batch and an audit."""
    conv, audit, at, state = None, "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, NEXT[state]
            yield conv, "Insert", NAMES[state], ""

    for batch in batches:
        for c, given, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "plan", "role", "text"))):
            if given is not None:
                yield from inserted()  # at the end of the conversation before
                conv, audit, at, state = c, given["audit"], 0, 0
                yield conv, None, given, None
                continue
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                yield conv, "Keep", role, text
            elif letter == "R":
                state = NEXT[state]
                yield conv, "Rerole", NAMES[state], text
            else:
                yield conv, "Delete", role, text
    yield from inserted()


def _streams(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows of conversations, each conversation in one stream after its plan."""
    empty = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "digest")}
    first = planned.select("conv", F.struct(*(c for c in planned.columns if c != "conv")).alias("plan"), *empty.values())
    both = rows.withColumn("plan", F.lit(None).cast(first.schema["plan"].dataType)).unionByName(first)
    return both.repartition("conv").sortWithinPartitions("conv", F.col("plan").isNull(), "turn", "role", "digest").select("conv", "plan", "role", "text")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits of conversations: conv_id, position (from 0 in the repaired one; null for deleted rows), edit, role, text, in order within
    each conversation's rows.

    Null role and text are one space; a null id is a conversation of its own; rows without a turn come first. Rows of one turn follow
    their role, then the digest of role and text. A role counts by its first letter; one with none of s, u and a (the empty one
    included) cannot be kept. Repeated rows are duplicates. Columns besides the four are not read. An empty table gives no rows.
    """
    ordered = _ordered(rows, conv_id, turn, role, text)
    schema = _typed("position long, edit string, role string, text string", ordered.schema["conv"].dataType)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, 0
        for conv, edit, who, what in _edits(batches):
            if edit is None:
                at = 0
                continue
            held.append((conv, None if edit == "Delete" else at, edit, who, what))
            at += edit != "Delete"
            size += 100 + len(what)
            if size > 4_000_000:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)

    return _streams(ordered, plans(ordered)).mapInArrow(write, schema).withColumnRenamed("conv", conv_id)


def repair_digests(rows: DataFrame, original: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of `original` (or of rows): conv_id, PLAN, repaired_sha256 of the repaired role:text lines.

    See repair() for nulls, ties and repeated rows. A conversation without rows has zeros, an empty audit and the empty text's digest.
    The digest is one stream per conversation, in one task, as SHA-256 is; it holds a batch of rows and the audit.
    """
    ordered = _ordered(rows, conv_id, turn, role, text)
    conv = ordered.schema["conv"].dataType
    schema = _typed(f"{PLAN}, repaired_sha256 string", conv)
    planned = plans(ordered)
    if original is not None:
        named = planned.withColumnRenamed("conv", "_conv")
        ids = original.select(F.col(conv_id).alias("conv")).distinct()
        numbers = [c for c, kind in planned.dtypes if kind == "bigint" and c != "conv"]
        planned = ids.join(named, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv").na.fill(0, numbers).na.fill("", ["audit"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, given, sha, lines = [], None, None, 0
        for conv, edit, who, what in _edits(batches):
            if edit is None:
                if sha:
                    held.append((*given, sha.hexdigest()))
                given, sha, lines = (conv, *who.values()), hashlib.sha256(), 0
                if len(held) >= 1000:
                    yield _batch(held, schema)
                    held = []
            elif edit != "Delete":
                sha.update(f"{chr(10) if lines else ''}{who}:{what}".encode())
                lines += 1
        if sha:
            yield _batch([*held, (*given, sha.hexdigest())], schema)

    return _streams(ordered, planned).mapInArrow(digest, schema).withColumnRenamed("conv", conv_id)


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with known faults, to measure repairs by: of 20 values of crc32("conv_id:turn"), 0 drops a row, 1 empties its text,
    2 removes the ends of its sentences, 3 repeats it, 4 makes it the user's. Nulls are one space, but for ids and turns returned."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in (conv_id, turn)))
    rows = rows.select(conv_id, turn, F.coalesce(role, blank).alias(role), F.coalesce(text, blank).alias(text), (F.crc32(key.cast("binary")) % 20).alias("_fault")).where("_fault <> 0")
    rows = rows.withColumn(text, F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)))
    rows = rows.withColumn(role, F.when(F.col("_fault") == 4, "user").otherwise(F.col(role)))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))).drop("_copy", "_fault")
