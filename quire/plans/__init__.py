"""All queries over the reference tables, with their SQL."""

from quire.plans import catalogue_queries, corpus_queries, deposit_queries, document_queries, gold_queries, harvest_queries, place_queries, relational_queries, stream_queries, table_queries
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue_queries", "corpus_queries", "deposit_queries", "document_queries", "gold_queries", "harvest_queries", "place_queries", "relational_queries", "stream_queries", "table_queries"]
