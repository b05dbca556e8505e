"""Spark jobs for corpora: cleaning, chunking, graphs, retrieval and evaluation."""
