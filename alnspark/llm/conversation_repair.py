"""Operator 12: the cheapest edits that make conversations well-formed, by A* on the edit lattice.

The initials of the roles have to match ``(s?(ua)+)?``.  A node is a number of turns consumed and a state of that expression; edits lead on: Keep (0),
Rerole to user or assistant (2), Delete (3; the only edit of blank and duplicate turns), Insert an empty user or assistant turn (2); a truncated
turn that isn't deleted adds 1.  The heuristic at a node is the suffix sum of what the remaining turns cost at least: 3 for
a mandatory deletion, 1 for a truncated turn.  It never exceeds the rest and falls by no more than an edit costs, so with keys (cost plus heuristic, audit)
the first visit of a node is by its cheapest edits and, of these, by those whose audit, the initials of the edits, is least.

A long conversation is cut into segments of SEGMENT turns.  Each is searched from every state it can be entered in to every state it can be
left in, and the tables of segments compose pairwise: costs add and audits join.  Two audits of equal cost for the same turns are never one the beginning of the
other, as the rest would be paid insertions, so the least audit of the whole consists of least audits of the parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch

#: Turns of a conversation that one search covers.
SEGMENT = 512
#: States: nothing yet, after s, after u, after a.  What each needs next (the first also takes s), where that leads, and which may be last.
NEEDS, LEADS, LAST = "uuau", (2, 2, 3, 2), (0, 3)
ROLE = {"u": "user", "a": "assistant"}
BLANK = r"^[\x20\x09-\x0D]*$"
COMPLETE = r"[.!?][\x20\x09-\x0D]*$"
Table = dict[tuple[int, int], tuple[int, str]]


def search(faults: str, initials: list[str], entry: int, whole: bool) -> Table:
    """Cheapest (cost, audit) from ``entry`` to each state after all turns; ``whole`` stops at the first that may be last.

    A fault is b (blank), d (duplicate), t (truncated) or . (none).
    """
    n = len(faults)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + {"b": 3, "d": 3, "t": 1, ".": 0}[faults[i]]
    heap, done, found = [(rest[0], "", 0, entry)], set(), {}
    while heap:
        key, audit, i, q = heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n:
            found[entry, q] = key, audit
            if whole and q in LAST:
                return {(entry, q): (key, audit)}
        heappush(heap, (key + 2, audit + "I", i, LEADS[q]))
        if i < n:
            on = key - rest[i] + rest[i + 1]
            heappush(heap, (on + 3, audit + "D", i + 1, q))
            if faults[i] in ".t":
                on += faults[i] == "t"
                heappush(heap, (on + 2, audit + "R", i + 1, LEADS[q]))
                if initials[i] == NEEDS[q]:
                    heappush(heap, (on, audit + "K", i + 1, LEADS[q]))
                elif initials[i] == "s" and q == 0:
                    heappush(heap, (on, audit + "K", i + 1, 1))
    return found


def compose(tables: list[Table]) -> Table:
    """The table of consecutive segments."""
    while len(tables) > 1:
        joined = []
        for a, b in zip(tables[::2], [*tables[1::2], None], strict=False):
            both: Table = {}
            for (p, q), (cost, audit) in a.items() if b is not None else ():
                for (r, s), (more, then) in b.items():
                    if q == r and ((p, s) not in both or (cost + more, audit + then) < both[p, s]):
                        both[p, s] = cost + more, audit + then
            joined.append(a if b is None else both)
        tables = joined
    return tables[0]


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def replay(audit: str, initials: Iterator[str]) -> Iterator[tuple[str, bool, str | None]]:
    """For each edit: its initial, whether it consumes a turn, and the role it writes (None: the turn's own)."""
    q = 0
    for edit in audit:
        initial = next(initials) if edit != "I" else ""
        written = ROLE[NEEDS[q]] if edit in "IR" else None
        if edit != "D":
            q = 1 if edit == "K" and initial == "s" and q == 0 else LEADS[q]
        yield edit, edit != "I", written


class Repair(NamedTuple):
    #: One row a conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    conversations: DataFrame
    #: One row an edit that leaves a turn: id, place (of the edit in the audit), edit, role, text.
    turns: DataFrame


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with pos, the place of each in its conversation by turn (nulls first), role and text.

    Rows are dealt by ranges of that order, so a long conversation lies in many parts; numbers within a part are added to the
    numbers of rows in the parts before it.
    """
    order = ["turn", "role", "text"]
    parts = materialise(rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "turns", keep=True)
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("conv", "part").count().select(F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    local = parts.withColumn("local", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)))
    return local.join(base, local["conv"].eqNullSafe(base["c"]) & (local["part"] == base["p"])).withColumn("pos", F.col("base") + F.col("local") - 1).drop("c", "p", "part", "base", "local")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` of placed() with the first fault that holds: blank, duplicate (role and text seen earlier in the conversation), truncated."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    firsts = rows.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), digest.alias("d")).agg(F.min("pos").alias("first"))
    met = rows.join(firsts, rows["conv"].eqNullSafe(firsts["c"]) & (rows["role"] == firsts["r"]) & (digest == firsts["d"]))
    fault = F.when(F.col("text").rlike(BLANK), "b").when(F.col("pos") > F.col("first"), "d").when(~F.col("text").rlike(COMPLETE), "t").otherwise(".")
    return met.select("conv", "pos", "turn", "role", "text", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))


def segment_tables(rows: DataFrame, kind: str) -> DataFrame:
    """(conv, seg, initials, illegal, entries, exits, costs, audits) of each segment."""
    seg = F.floor(F.col("pos") / SEGMENT)
    packed = rows.groupBy("conv", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "fault", "initial"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, seg, turns in zip(*batch.columns, strict=True):
                turns, seg = turns.as_py(), seg.as_py()
                faults, initials = "".join(t["fault"] for t in turns), [t["initial"] for t in turns]
                table: Table = {}
                for entry in range(4) if seg else (0,):
                    table |= search(faults, initials, entry, whole=seg == 0 and len(turns) < SEGMENT)
                out.append((conv.as_py(), seg, initials, illegal(initials), [p for p, _ in table], [q for _, q in table], [c for c, _ in table.values()], [a for _, a in table.values()]))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema)

    names = ["conv", "seg", "initials", "illegal", "entries", "exits", "costs", "audits"]
    number, numbers, strings = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())
    schema = pa.schema(list(zip(names, [rows_kind(kind), number, strings, number, numbers, numbers, numbers, strings], strict=True)))
    return packed.mapInArrow(run, f"conv {kind}, seg long, initials array<string>, illegal long, entries array<long>, exits array<long>, costs array<long>, audits array<string>")


def rows_kind(kind: str) -> pa.DataType:
    """The Arrow type of ids."""
    if kind not in ("bigint", "int", "string"):
        raise ValueError(f"ids of type {kind} are neither integers nor strings")
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def solve(segments: DataFrame, kind: str) -> DataFrame:
    """(conv, illegal, cost, audit, edits) of each conversation; an edit is (place, edit, pos or null, written role or null).

    A row holds one byte an edit in its audit and the edits themselves, so it grows with its conversation, as its result does.
    """
    fields = ("seg", "initials", "illegal", "entries", "exits", "costs", "audits")
    packed = segments.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, parts in zip(*batch.columns, strict=True):
                parts = parts.as_py()
                tables = [{(p, q): (c, a) for p, q, c, a in zip(x["entries"], x["exits"], x["costs"], x["audits"], strict=True)} for x in parts]
                cost, audit = min(v for (p, q), v in compose(tables).items() if p == 0 and q in LAST)
                broken = sum(x["illegal"] for x in parts) + sum(illegal([a["initials"][-1], b["initials"][0]]) for a, b in zip(parts, parts[1:], strict=False))
                pos, edits = -1, []
                for place, (edit, consumes, written) in enumerate(replay(audit, (c for x in parts for c in x["initials"]))):
                    pos += consumes
                    if edit != "D":
                        edits.append({"place": place, "edit": edit, "pos": pos if consumes else None, "written": written})
                yield pa.RecordBatch.from_pylist([{"conv": conv.as_py(), "illegal": broken, "cost": cost, "audit": audit, "edits": edits}], schema)

    edit = pa.struct([("place", pa.int64()), ("edit", pa.string()), ("pos", pa.int64()), ("written", pa.string())])
    schema = pa.schema([("conv", rows_kind(kind)), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(edit))])
    return packed.mapInArrow(run, f"conv {kind}, illegal long, cost long, audit string, edits array<struct<place: long, edit: string, pos: long, written: string>>")


def repair_conversations(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """The faults of conversations and the cheapest edits that repair their structure; see the module.

    Turns are taken by number, nulls first; turns of one number by role and text.  Null roles and texts count as one space, rows of a null id as one
    conversation.  blank, duplicate and truncated count first faults, illegal the adjacent turns whose role initials aren't su, ua
    or au, gaps the numbers missing between the least and the greatest.  Of edits of equal cost those whose audit is least count.  An empty
    table has no conversations; a conversation whose turns are all deleted has an audit of D only and no repaired turns.  Other columns don't matter.
    """
    kind = conversations.schema[id_col].dataType.simpleString()
    rows_kind(kind)
    blank = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    rows = conversations.select(conversations[id_col].alias("conv"), conversations[turn_col].cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    with scratch(conversations.sparkSession):
        rows = materialise(with_faults(placed(rows)), "faults", keep=True)
        solved = materialise(solve(segment_tables(rows.select("conv", "pos", "fault", "initial"), kind), kind), "edits", keep=True)
        count = lambda x: F.count(F.when(F.col("fault") == x, 1))
        span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        counted = rows.groupBy(F.col("conv").alias("c")).agg(F.coalesce(span, F.lit(0)).alias("gaps"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
        summary = solved.join(counted, solved["conv"].eqNullSafe(counted["c"])).select(F.col("conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        edits = solved.select("conv", F.explode("edits").alias("e")).select(F.col("conv").alias("c"), "e.*")
        here = edits.join(rows, edits["c"].eqNullSafe(rows["conv"]) & (edits["pos"] == rows["pos"]), "left")
        turns = here.select(F.col("c").alias(id_col), "place", "edit", F.coalesce("written", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return Repair(summary, turns)


def transcript_digests(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, sha256) of the ``role:text`` of a conversation's turns by place, joined by newlines.

    Sorted rows pass as a stream, so a conversation of any length is hashed without being held.
    """
    kind = turns.schema[id_col].dataType.simpleString()
    rows = turns.select(id_col, "place", F.concat_ws(":", "role", "text").alias("line")).repartition(id_col).sortWithinPartitions(id_col, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            out = []
            for c, place, line in zip(*batch.columns, strict=True):
                c, line = c.as_py(), line.as_py().encode()
                if state is None or c != conv:
                    if state is not None:
                        out.append({id_col: conv, "sha256": state.hexdigest()})
                    conv, state = c, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{id_col: conv, "sha256": state.hexdigest()}], schema)

    schema = pa.schema([(id_col, rows_kind(kind)), ("sha256", pa.string())])
    return rows.mapInArrow(run, f"`{id_col}` {kind}, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text; nulls count as one space) with faults drawn by crc32 of ``conv_id:turn`` modulo 20: 0 drops
    the row, 1 empties the text, 2 removes its full stops, exclamation and question marks, 3 repeats the row, 4 makes it the user's."""
    blank = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    code: Column = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", code.alias("code"), blank("role").alias("role"), blank("text").alias("text")).where("code <> 0")
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
