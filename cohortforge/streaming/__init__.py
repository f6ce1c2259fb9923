"""Structured Streaming forms of the two single-sample verbs."""
