"""All named queries of the series part."""

from . import engine_queries, estimator_queries, model_queries, scale_queries, series_queries, stat_queries, wide_queries

_PARTS = (series_queries, stat_queries, engine_queries, wide_queries, scale_queries, model_queries, estimator_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
