"""Sources and sinks of retrieval collections, records and reports."""
