"""Reading and writing graphs, features, embeddings and rewards."""
