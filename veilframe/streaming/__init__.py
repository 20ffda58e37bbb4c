"""Structured Streaming forms of stateless and incremental operators."""
