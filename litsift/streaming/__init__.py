"""Streaming forms of sequential operators."""
