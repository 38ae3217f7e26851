"""Declared schemas; nothing is inferred."""

DOCUMENTS = "doc_id string, title string, text string"
QUERIES = "query_id string, text string"
QRELS = "query_id string, doc_id string, relevance int"
FEATURES = "item string, feature string, value double"
RANKINGS = "query string, config string, rank int, item string, score double"
OUTCOMES = "row_id string, query string, config string, value double"
TRACES = "unit string, item string, counts double, opportunities double, mass double"
