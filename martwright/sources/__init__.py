"""Readers, landed-page normalisers, caches and sinks."""
