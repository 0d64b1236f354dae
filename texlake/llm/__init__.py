"""Training-data operators over the documents, embeddings, benchmark and labels tables."""
