"""Connected components, as the graph operators find them."""

from __future__ import annotations

from corpusloom.operators.graph_paths import components

__all__ = ["components"]
