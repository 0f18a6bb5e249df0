"""plumbline: typo-tolerant full-text search and ranking on Spark DataFrames."""

from plumbline.operators.index import Index, IndexConfig, build_index, index_stats, read_index
from plumbline.operators.shards import build_shards
from plumbline.plans.engine import Response, SearchEngine, explain
from plumbline.plans.params import InvalidParams, is_query_params, parse_query_body
from plumbline.plans.scatter import search as search_batch
from plumbline.session import local_session

__all__ = [
    "Index", "IndexConfig", "InvalidParams", "Response", "SearchEngine", "build_index", "build_shards", "explain", "index_stats",
    "is_query_params", "local_session", "parse_query_body", "read_index", "search_batch",
]
