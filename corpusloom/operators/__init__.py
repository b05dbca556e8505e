"""DataFrame operators: ingest, chunking, graph, vectors, retrieval, context, evaluation."""
