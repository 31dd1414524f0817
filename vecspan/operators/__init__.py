"""operators of the vector engine."""
