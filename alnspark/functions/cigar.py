"""CIGAR operations as Column expressions over ARRAY<STRUCT<n INT, op STRING>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CIGAR_DDL

MATCH = ("M", "=", "X")
#: The operations that consume the reference and those that consume the read.
REFERENCE = ("M", "=", "X", "D", "N")
QUERY = ("M", "=", "X", "I", "S")


def parse(text: Column) -> Column:
    """``3M1I`` to items; ``*`` and null to no items."""
    items = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(items, lambda t: item(F.substring(t, 1, F.length(t) - 1), F.right(t, F.lit(1))))


def render(ops: Column) -> Column:
    """Items to text, no items to ``*``."""
    return F.when(F.size(ops) > 0, F.array_join(F.transform(ops, lambda x: F.concat(x["n"].cast("string"), x["op"])), "")).otherwise(F.lit("*"))


def item(n: Column, op: Column | str) -> Column:
    return F.struct(n.cast("int").alias("n"), (F.lit(op) if isinstance(op, str) else op).alias("op"))


def collapse(ops: Column) -> Column:
    """Items of no length left out, neighbours of the same operation joined."""
    empty = F.array().cast(CIGAR_DDL)

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["op"] == x["op"])
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(item(last["n"] + x["n"], x["op"])))).otherwise(F.concat(done, F.array(item(x["n"], x["op"]))))

    return F.aggregate(F.filter(ops, lambda x: x["n"] > 0), empty, add)


def length_of(ops: Column, of: tuple[str, ...]) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*of)), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])


def reference_length(ops: Column) -> Column:
    return length_of(ops, REFERENCE)


def query_length(ops: Column) -> Column:
    return length_of(ops, QUERY)


def right_anchored_length(ops: Column) -> Column:
    """Reference length up to and with the last base that is aligned; 0 without one."""
    after = F.filter(F.transform(ops, lambda x, k: F.when(x["op"].isin(*MATCH), k + 1)), lambda k: k.isNotNull())
    return reference_length(F.slice(ops, 1, F.greatest(F.lit(0), F.coalesce(F.array_max(after), F.lit(0)))))


def record_length(ops: Column, include_clipping: bool = False) -> Column:
    """Length on the reference; with ``include_clipping`` insertions and soft clips count too."""
    return length_of(ops, REFERENCE + (("I", "S") if include_clipping else ()))


def canonical(ops: Column, padding: bool = False) -> Column:
    """Two CIGARs are equivalent when these are equal: within a run of I and D (and P with ``padding``) only the totals of I and D
    count; a run without any of them vanishes."""
    run = ("I", "D", "P") if padding else ("I", "D")
    kind = "array<struct<op:string,i:bigint,d:bigint>>"

    def add(done: Column, x: Column) -> Column:
        i = F.when(x["op"] == "I", x["n"]).otherwise(0).cast("bigint")
        d = F.when(x["op"] == "D", x["n"]).otherwise(0).cast("bigint")
        last = F.element_at(done, -1)
        one = lambda op, a, b: F.array(F.struct(F.lit(op).alias("op") if isinstance(op, str) else op.alias("op"), a.alias("i"), b.alias("d")))
        in_run = x["op"].isin(*run)
        grows = in_run & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["op"] == "run")
        return (
            F.when(grows, F.concat(F.slice(done, 1, F.size(done) - 1), one("run", last["i"] + i, last["d"] + d)))
            .when(in_run, F.concat(done, one("run", i, d)))
            .otherwise(F.concat(done, one(x["op"], x["n"].cast("bigint"), F.lit(0).cast("bigint"))))
        )

    folded = F.aggregate(ops, F.array().cast(kind), add)
    return F.filter(folded, lambda x: (x["op"] != "run") | (x["i"] + x["d"] > 0))


def equivalent(a: Column, b: Column, padding: bool = False) -> Column:
    return canonical(a, padding) == canonical(b, padding)


def to_alignment_match(ops: Column) -> Column:
    """= and X become M; neighbours are joined."""
    return collapse(F.transform(ops, lambda x: item(x["n"], F.when(x["op"].isin("=", "X"), F.lit("M")).otherwise(x["op"]))))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def positions(ops: Column, start: Column) -> Column:
    """Items with the reference and read position at which each begins: (n, op, ref, query)."""
    kind = "array<struct<n:int,op:string,ref:bigint,query:bigint>>"
    state = F.struct(F.array().cast(kind).alias("done"), start.cast("bigint").alias("ref"), F.lit(0).cast("bigint").alias("query"))

    def step(s: Column, x: Column) -> Column:
        moved = lambda of: F.when(x["op"].isin(*of), x["n"]).otherwise(F.lit(0)).cast("bigint")
        here = F.struct(x["n"].alias("n"), x["op"].alias("op"), s["ref"].alias("ref"), s["query"].alias("query"))
        return F.struct(F.concat(s["done"], F.array(here)).alias("done"), (s["ref"] + moved(REFERENCE)).alias("ref"), (s["query"] + moved(QUERY)).alias("query"))

    return F.aggregate(ops, state, step, lambda s: s["done"])


def indel_runs(ops: Column, start: Column) -> Column:
    """Maximal runs of I and D that hold both: (first, last, ref_start, ref_end, query_start, query_end), items counted from 0."""
    names = ("first", "last", "ref_start", "ref_end", "query_start", "query_end")
    run = "struct<" + ",".join(f"{n}:bigint" for n in names) + ",has_i:boolean,has_d:boolean>"
    none = F.lit(None).cast(run)
    state = F.struct(F.lit(0).cast("bigint").alias("k"), F.array().cast(f"array<{run}>").alias("done"), none.alias("open"))

    def step(s: Column, x: Column) -> Column:
        is_i, is_d, old = x["op"] == "I", x["op"] == "D", s["open"]
        to_r, to_q = x["ref"] + F.when(is_d, x["n"]).otherwise(0), x["query"] + F.when(is_i, x["n"]).otherwise(0)
        kept = lambda name, new: F.coalesce(old[name], new).alias(name)
        grown = F.struct(
            kept("first", s["k"]), s["k"].alias("last"), kept("ref_start", x["ref"]), to_r.alias("ref_end"), kept("query_start", x["query"]), to_q.alias("query_end"),
            (F.coalesce(old["has_i"], F.lit(False)) | is_i).alias("has_i"), (F.coalesce(old["has_d"], F.lit(False)) | is_d).alias("has_d"),
        )
        shut = F.when(old.isNotNull(), F.concat(s["done"], F.array(old))).otherwise(s["done"])
        return F.struct((s["k"] + 1).alias("k"), F.when(is_i | is_d, s["done"]).otherwise(shut).alias("done"), F.when(is_i | is_d, grown).otherwise(none).alias("open"))

    end = lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
    found = F.filter(F.aggregate(positions(ops, start), state, step, end), lambda r: r["has_i"] & r["has_d"])
    return F.transform(found, lambda r: F.struct(*(r[n].alias(n) for n in names)))


def may_continue(before: Column, op: Column) -> Column:
    """Whether an operation can continue one before it: D and N, H and P go together, others only with themselves."""
    kind = lambda c: F.when(c.isin("D", "N"), F.lit("D")).when(c.isin("H", "P"), F.lit("H")).otherwise(c)
    return kind(before) == kind(op)


def to_sequence_match(ops: Column, seq: Column, reference: Column, start: Column) -> Column:
    """M becomes = or X by comparing read and reference base by base; other items stay as they are, unmerged."""
    part = lambda text, at, n: F.substring(text, (at + 1).cast("int"), n)

    def runs(x: Column) -> Column:
        """Equal letters as =, others as X, then the runs of either."""
        pairs = F.arrays_zip(F.split(part(seq, x["query"], x["n"]), ""), F.split(part(reference, x["ref"], x["n"]), ""))
        marks = F.array_join(F.transform(pairs, lambda p: F.when(p["0"] == p["1"], "=").otherwise("X")), "")
        return F.transform(F.regexp_extract_all(marks, F.lit("(=+|X+)"), F.lit(1)), lambda r: item(F.length(r), F.substring(r, 1, 1)))

    each = lambda x: F.when(x["op"] == "M", runs(x)).otherwise(F.array(item(x["n"], x["op"])))
    return F.flatten(F.transform(F.filter(positions(ops, start), lambda x: x["n"] > 0), each))


def reference_n_positions(ops: Column, reference: Column, start: Column) -> Column:
    """Offsets from ``start`` at which the reference has N under an operation that consumes it."""
    length = reference_length(ops)
    under = F.substring(reference, (start + 1).cast("int"), length.cast("int"))
    return F.filter(F.transform(F.split(under, ""), lambda c, k: F.when(c == "N", k.cast("bigint"))), lambda k: k.isNotNull())
