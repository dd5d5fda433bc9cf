"""plans of the compliance engine."""
