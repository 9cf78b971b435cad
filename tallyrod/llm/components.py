"""Connected components, which other parts of the library use too."""

from ..operators.components import components

__all__ = ["components"]
