"""All registered queries of the core."""

from __future__ import annotations

from spotweave.plans import cluster_queries, marker_queries, matrix_queries, model_queries, problems, raster_queries, spatial_queries

_MODULES = (problems, matrix_queries, marker_queries, spatial_queries, cluster_queries, raster_queries, model_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
FLAGSHIP = marker_queries.fast_markers
