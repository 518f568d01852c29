"""The graph as plain DataFrames: one per node label, one per relationship type."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Graph:
    """``nodes[label]`` holds one row per key, ``edges[type]`` holds ``src, dst`` and properties."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def merged_with(self, other: "Graph") -> "Graph":
        """Both graphs side by side; labels and types of ``other`` replace those of the same name."""
        return Graph({**self.nodes, **other.nodes}, {**self.edges, **other.edges})
