"""Library-shaped views over plain tables, and the registered queries with their SQL."""


def registries() -> list:
    from . import catalog_queries, graph_queries, ingest_queries, playlist_queries, similar_queries

    return [catalog_queries.R, ingest_queries.R, playlist_queries.R, similar_queries.R, graph_queries.R]
