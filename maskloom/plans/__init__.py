"""The registered queries."""

from __future__ import annotations

from maskloom.plans.tables import Query


def all_queries() -> list[Query]:
    from maskloom.plans import detecting, naming, rewriting, selecting, streams

    return [*rewriting.QUERIES, *detecting.QUERIES, *selecting.QUERIES, *naming.QUERIES, *streams.QUERIES]
