"""functions of the vector engine."""
