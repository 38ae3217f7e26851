"""Extension: collection statistics over a stream of documents."""
