"""Registered queries over the derived views.  Importing this package registers all of them."""

from . import correct_queries, finish_queries, graph_queries, inspect_queries, kmer_queries, number_queries, read_queries, set_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
