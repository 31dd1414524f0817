"""streaming of the vector engine."""
