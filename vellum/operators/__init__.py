"""DataFrame operators: chunking, encoding, indexes, search, gates, evaluation."""
