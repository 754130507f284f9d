"""Spark jobs for large text archives: cleaning, chunking, indexing, search, graphs and streams."""
