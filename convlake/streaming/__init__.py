"""Streaming forms of the operators that take appended input."""
