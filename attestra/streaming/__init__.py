"""streaming of the compliance engine."""
