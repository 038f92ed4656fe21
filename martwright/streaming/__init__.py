"""Streaming twins of the call-audit operators."""
