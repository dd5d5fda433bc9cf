"""operators of the compliance engine."""
