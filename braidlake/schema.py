"""Handles, canonical forms and the schemas of all tables.

A handle is an oriented node: 2 * node_id + 1 if reverse. The canonical rules live here and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORWARD, REVERSE = 0, 1
LEFT, RIGHT = 0, 1
VERSION = "1"

NODES = "node_id long, sequence string, seq_len long"
EDGES = "src long, dst long"
CHAIN_LINKS = "handle long, next long"
PATHS = "path_handle long, sample string, contig string, haplotype long, fragment long, is_indexed boolean, path_len long"
STEPS = "path_handle long, step long, handle long, step_start long, step_end long"
TAGS = "key string, value string"
REFERENCE_INDEX = "path_handle long, path_offset long, node_handle long, step long"


def node_of(h: Column) -> Column:
    return F.shiftright(h, 1)


def is_reverse(h: Column) -> Column:
    return h.bitwiseAND(F.lit(1))


def flip(h: Column) -> Column:
    return h.bitwiseXOR(F.lit(1))


def encode(node_id: Column, rev: Column) -> Column:
    return (node_id * 2 + rev).cast("long")


def flipped_path(path: Column) -> Column:
    return F.transform(F.reverse(path), flip)


def edge_is_canonical(src: Column, dst: Column) -> Column:
    """One of an edge's two mirror forms: from a forward handle up, or from a reverse one strictly up or to a forward loop."""
    a, b = node_of(src), node_of(dst)
    return F.when(is_reverse(src) == 0, b >= a).otherwise((b > a) | ((b == a) & (is_reverse(dst) == 0)))


def handle(node_id: int, rev: int = FORWARD) -> int:
    return 2 * node_id + rev


def canonical_edge(src: int, dst: int) -> bool:
    a, b = src >> 1, dst >> 1
    return b >= a if not src & 1 else b > a or (b == a and not dst & 1)


def canonical_snarl(start: int, end: int) -> tuple[int, int]:
    return (start, end) if canonical_edge(start, end) else (end ^ 1, start ^ 1)


def walk_text(path: Column) -> Column:
    """>id or <id for each handle."""
    return F.array_join(F.transform(path, lambda h: F.concat(F.when(is_reverse(h) == 0, ">").otherwise("<"), node_of(h).cast("string"))), "")


@dataclass(frozen=True)
class Graph:
    """A bidirected sequence graph with haplotype paths. steps have offsets; edges hold both mirror forms.

    steps_by_node: the same steps in the order of their handles, for those near some nodes, if a store has them.
    """

    nodes: DataFrame
    edges: DataFrame
    steps: DataFrame
    paths: DataFrame
    chain_links: DataFrame
    tags: DataFrame
    steps_by_node: DataFrame | None = None

    @property
    def spark(self):
        return self.nodes.sparkSession
