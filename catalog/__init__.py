"""Registered queries over the test tables, and their SQL twins."""

from __future__ import annotations


def _load():
    from catalog import aggregates, analytics, registry, scalars, sources, streams  # noqa: F401

    return registry


def all_queries():
    return dict(_load().QUERIES)


def oracle_text():
    return dict(_load().ORACLE)
