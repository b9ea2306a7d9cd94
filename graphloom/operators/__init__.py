"""Operators over the tables of a graph: edges (src, dst, weight, p), features, embeddings."""
