"""Finding graphs: in a module by name, or in a Python file."""

from __future__ import annotations

import importlib
import importlib.util
import os

from .plans.graph import Composite, Graph, GraphError


def load_graph(target: str, attribute: str | None = None) -> Graph:
    """The graph of a module name or file path: the named attribute, else the only Graph in it that no composite holds."""
    if os.path.isfile(target):
        spec = importlib.util.spec_from_file_location(os.path.splitext(os.path.basename(target))[0], target)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    else:
        module = importlib.import_module(target)
    if attribute:
        found = getattr(module, attribute, None)
        if not isinstance(found, Graph):
            raise GraphError(f"{attribute} of {target} is not a graph")
        return found
    graphs = [v for v in vars(module).values() if isinstance(v, Graph)]
    inner = {id(n.graph) for g in graphs for n in g.nodes if isinstance(n, Composite)}
    outer = list({id(g): g for g in graphs if id(g) not in inner}.values())
    if len(outer) != 1:
        raise GraphError(f"{target} has {len(outer)} graphs; name one")
    return outer[0]
