"""Registered queries of the engine, each with its SQL counterpart where SQL can express it."""

from folio.queries import corpus, fixture_queries

__all__ = ["corpus", "fixture_queries"]
