"""sources of the compliance engine."""
