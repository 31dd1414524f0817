"""plans of the vector engine."""
