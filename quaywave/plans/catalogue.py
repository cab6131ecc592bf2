"""All registered queries of the library's own operators, with their DuckDB texts."""

from . import file_queries, model_queries, signal_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
