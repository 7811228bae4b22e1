"""Collects the registered queries of every plan module."""

from __future__ import annotations


def _load():
    from perfengine.plans import queries  # noqa: F401  (registers on import)
    from perfengine.plans import queries_more  # noqa: F401
    from perfengine.plans import queries_ml  # noqa: F401
    return queries


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLE)
