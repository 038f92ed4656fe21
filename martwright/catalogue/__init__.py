"""Registered queries: every operator on the benchmark tables, with the SQL that must give the same rows."""

from martwright.catalogue import columns, histories, marts, profiles, scans, streams  # noqa: F401  (they register)
from martwright.catalogue.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
