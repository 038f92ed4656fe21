"""Operators for training-data pipelines, with their queries and the SQL that must give the same rows."""

from martwright.llm import ann, chat, langid, mixing, pieces, quality, sharding, simhash, spelling, tensor, tokens, topk, trie  # noqa: F401  (they register)
from martwright.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
