"""All runnable queries, by area."""

from traceworks.registry.base import ORACLES, QUERIES
from traceworks.registry import (  # noqa: F401
    q_ledger,
    q_quality,
    q_audit,
    q_market,
    q_policy,
    q_sources,
    q_retrieval,
    q_filings,
    q_basics,
    q_streaming,
    q_models,
)

__all__ = ["ORACLES", "QUERIES"]
