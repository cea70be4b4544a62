"""What a run is given: a JSON file, else JSON text, else a number of iterations."""

from __future__ import annotations

import json

from ..plans.graph import Graph, GraphError


def load_inputs(graph: Graph, file: str | None = None, text: str | None = None, iterations: int | None = None) -> dict:
    """{node name or id: number or list}. A file goes before text, text before a number; the number (1 if nothing
    is given) holds for every root. Wrong JSON, and a file that can't be read, are errors."""
    if file is not None:
        with open(file) as f:
            found = json.load(f)
    elif text is not None:
        found = json.loads(text)
    else:
        return {node: 1 if iterations is None else iterations for node in graph.flatten().roots()}
    if not isinstance(found, dict):
        raise GraphError(f"inputs must be an object of node names, not {type(found).__name__}")
    return found
