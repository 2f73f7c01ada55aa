"""Structured Streaming forms of the memo rules."""
