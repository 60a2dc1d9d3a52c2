"""The queries of this engine over the given tables, each beside its ANSI-SQL counterpart."""

from __future__ import annotations

from tomeweave.plans.registry import catalogs, corpus, files, models, pages, terms

_MODULES = (corpus, files, terms, models, catalogs, pages)


def all_queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
