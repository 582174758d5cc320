"""All queries of the core with their SQL."""

from strandwork.plans import composed_queries, data_problems, event_queries, graph_queries, product_queries, source_queries, spec_queries, text_queries

FLAGSHIP = "orient"
_PARTS = (data_problems, graph_queries, event_queries, text_queries, source_queries, composed_queries, spec_queries, product_queries)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PARTS for k, s in p.SQL.items()}
