"""Connected components of a link table: the engine's own."""

from __future__ import annotations

from ..operators.graph import components  # noqa: F401  the operators of this subpackage take it from here
