"""Difference strings as arrays of (op, len, seq), in column expressions.

Ops: `:` match, `*` mismatch (seq is the query base), `+` insertion, `-` deletion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "array<struct<op:string,len:bigint,seq:string>>"
_TOKEN = r"[=:*+\-][^=:*+\-]*"
VALID = r"^(=[A-Za-z]+|:[0-9]+|\*[A-Za-z]{2}|\+[A-Za-z]+|-[A-Za-z]+)*$"


def is_valid(cs: Column) -> Column:
    return F.rlike(cs, F.lit(VALID))


def parse(cs: Column) -> Column:
    def op(token: Column) -> Column:
        kind, rest = F.substring(token, 1, 1), F.upper(F.substr(token, F.lit(2)))
        size = F.length(rest).cast("long")
        none = F.lit(None).cast("string")
        return (
            F.when(kind == ":", _op(":", rest.try_cast("long"), none)).when(kind == "=", _op(":", size, none))
            .when(kind == "*", _op("*", F.lit(1).cast("long"), F.substr(rest, F.lit(2)))).when(kind == "+", _op("+", size, rest)).otherwise(_op("-", size, none))
        )

    return F.transform(F.regexp_extract_all(cs, F.lit(_TOKEN), F.lit(0)), op)


def _op(kind, size: Column, seq: Column) -> Column:
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("op"), size.alias("len"), seq.alias("seq"))


def normalize(ops: Column) -> Column:
    """Drops empty ops and merges neighbours of a kind, mismatches apart."""

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        same = (F.size(out) > 0) & (x["op"] != "*") & (F.try_element_at(out, F.lit(-1))["op"] == x["op"])
        merged = _op(x["op"], last["len"] + x["len"], F.concat(last["seq"], x["seq"]))
        return F.when(x["len"] == 0, out).when(same, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(merged))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(ops, F.array().cast(OPS), step)


def _sum(ops: Column, kinds: str) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"].isin(list(kinds)), x["len"]).otherwise(0))


def query_len(ops: Column) -> Column:
    return _sum(ops, ":*+")


def target_len(ops: Column) -> Column:
    return _sum(ops, ":*-")


def matches(ops: Column) -> Column:
    return _sum(ops, ":")


def edits(ops: Column) -> Column:
    return _sum(ops, "*+-")


def to_text(ops: Column, target: Column) -> Column:
    """The difference string; target is the aligned part of the target sequence."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("s"))

    def step(a: Column, x: Column) -> Column:
        here = F.substr(target, (a["at"] + 1).cast("int"), x["len"].cast("int"))
        text = F.when(x["op"] == ":", F.concat(F.lit(":"), x["len"].cast("string"))).when(x["op"] == "*", F.concat(F.lit("*"), here, x["seq"]))
        text = text.when(x["op"] == "+", F.concat(F.lit("+"), x["seq"])).otherwise(F.concat(F.lit("-"), here))
        return F.struct((a["at"] + F.when(x["op"] == "+", 0).otherwise(x["len"])).alias("at"), F.concat(a["s"], text).alias("s"))

    return F.aggregate(ops, zero, step)["s"]
