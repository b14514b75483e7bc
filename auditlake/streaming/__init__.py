"""Structured Streaming forms of the stateless scan and request suppression."""
