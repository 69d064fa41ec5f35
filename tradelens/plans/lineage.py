"""Model lineage as an edge list, taken from the builders' own input lists."""

from __future__ import annotations

from tradelens.plans.models import LINEAGE, qualified


def lineage_edges() -> list[tuple[str, str, str]]:
    """``(model, layer, input)`` for every input of every model, inputs qualified."""
    edges = []
    for model, (layer, inputs) in LINEAGE.items():
        for dep in inputs:
            edges.append((qualified(model), layer, dep if dep.startswith("raw.") else qualified(dep)))
    return edges
