"""sources of the vector engine."""
