"""Chunking, embedding, search and cataloguing of retrieval corpora on Spark."""
