"""functions of the compliance engine."""
