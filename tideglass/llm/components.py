"""Connected components: those of the operators."""

from tideglass.operators.components import connected_components  # noqa: F401
