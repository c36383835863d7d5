"""Names of graphs: a stable name, and which graphs are known to be subgraphs of which."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

NAME, SUBGRAPHS = "graph_name", "graph_subgraphs"


@dataclass(frozen=True)
class GraphName:
    """A name, if known, and pairs (graph, graph that it is a subgraph of)."""

    name: str | None = None
    subgraphs: tuple[tuple[str, str], ...] = ()

    @classmethod
    def from_tags(cls, tags: dict[str, str], strict: bool = False) -> GraphName:
        """From a store's tags. What cannot be read is an error if strict, and no name otherwise."""
        pairs = tuple(tuple(p.split(",")) for p in (tags.get(SUBGRAPHS) or "").split(";") if p)
        if any(len(p) != 2 or not all(p) for p in pairs):
            if strict:
                raise ValueError(f"bad subgraph relations: {tags[SUBGRAPHS]}")
            return cls()
        return cls(tags.get(NAME) or None, pairs)

    @classmethod
    def from_headers(cls, lines: Iterable[str]) -> GraphName:
        """From header lines of alignment text (@RN, @SG) or graph text (H with NM or SG)."""
        name, pairs = None, []
        for line in lines:
            head, *fields = line.rstrip("\n").split("\t")
            if head == "H":
                for f in fields:
                    name = f[5:] if f.startswith("NM:Z:") else name
                    pairs += [tuple(f[5:].split(","))] if f.startswith("SG:Z:") else []
            elif head == "@RN" and fields:
                name = fields[0]
            elif head == "@SG" and len(fields) == 2:
                pairs.append(tuple(fields))
        return cls(name, tuple(p for p in pairs if len(p) == 2))

    def tags(self) -> dict[str, str]:
        out = {NAME: self.name} if self.name else {}
        return out | ({SUBGRAPHS: ";".join(",".join(p) for p in self.subgraphs)} if self.subgraphs else {})

    def gaf_headers(self) -> list[str]:
        return ([f"@RN\t{self.name}"] if self.name else []) + [f"@SG\t{a}\t{b}" for a, b in self.subgraphs]

    def gfa_headers(self) -> list[str]:
        return ([f"H\tNM:Z:{self.name}"] if self.name else []) + [f"H\tSG:Z:{a},{b}" for a, b in self.subgraphs]

    def subgraph_of(self, parent: GraphName) -> GraphName:
        """This name with the parent's relations, and as a subgraph of the parent."""
        own = ((self.name, parent.name),) if self.name and parent.name and self.name != parent.name else ()
        return replace(self, subgraphs=tuple(dict.fromkeys((*self.subgraphs, *parent.subgraphs, *own))))

    def is_subgraph_of(self, other: GraphName) -> bool:
        """Whether relations that either side knows lead from this name to the other."""
        above: dict[str, set[str]] = {}
        for a, b in (*self.subgraphs, *other.subgraphs):
            above.setdefault(a, set()).add(b)
        seen, todo = set(), [self.name]
        while todo:
            at = todo.pop()
            if at == other.name:
                return True
            if at not in seen:
                seen.add(at)
                todo += above.get(at, ())
        return False


def require_reference(alignments: GraphName, graph: GraphName) -> None:
    """Fails if both names are known and the alignments' graph is not known to be a subgraph of the other."""
    if alignments.name and graph.name and not alignments.is_subgraph_of(graph):
        raise ValueError(f"the graph is not a valid reference for the alignments: {alignments.name} is not a subgraph of {graph.name}")
