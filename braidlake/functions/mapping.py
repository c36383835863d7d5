"""Lengths and places of difference ops and of mappings, as column expressions.

An op is a struct (op, len, seq); a mapping has the columns or fields of `operators.reads.mappings`: handle, node_start,
node_end, node_len, query_start, query_end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def op_len(op: Column) -> Column:
    return op["len"]


def op_query_len(op: Column) -> Column:
    return F.when(op["op"].isin(":", "*", "+"), op["len"]).otherwise(0).cast("long")


def op_target_len(op: Column) -> Column:
    return F.when(op["op"].isin(":", "*", "-"), op["len"]).otherwise(0).cast("long")


def op_is_empty(op: Column) -> Column:
    return op["len"] == 0


def _of(mapping: Column | None, name: str) -> Column:
    return F.col(name) if mapping is None else mapping[name]


def query_len(mapping: Column | None = None) -> Column:
    return _of(mapping, "query_end") - _of(mapping, "query_start")


def target_len(mapping: Column | None = None) -> Column:
    return _of(mapping, "node_end") - _of(mapping, "node_start")


def is_unaligned(mapping: Column | None = None) -> Column:
    """Whether it is an insertion that lies on no node."""
    return _of(mapping, "handle") == 0


def is_at_start(mapping: Column | None = None) -> Column:
    return _of(mapping, "node_start") == 0


def is_at_end(mapping: Column | None = None) -> Column:
    return _of(mapping, "node_end") == _of(mapping, "node_len")


def follows(before: Column, mapping: Column | None = None) -> Column:
    """Whether a mapping goes on where another ends, in the same node."""
    return (_of(mapping, "handle") == before["handle"]) & (_of(mapping, "node_start") == before["node_end"])
