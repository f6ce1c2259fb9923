"""Registered queries: each pairs a Spark callable with its DuckDB oracle."""

from __future__ import annotations

from importlib import import_module

GROUPS = [
    "scoring_queries",
    "harmonise_queries",
    "endpoint_queries",
    "quality_queries",
    "survival_queries",
    "stream_queries",
    "source_queries",
    "contract_queries",
    "record_queries",
]


def catalogue() -> dict:
    """Name to (callable, oracle SQL or None), over all groups."""
    out: dict = {}
    for group in GROUPS:
        entries = import_module(f"cohortforge.catalogue.{group}").QUERIES
        clash = set(out) & set(entries)
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(entries)
    return out
