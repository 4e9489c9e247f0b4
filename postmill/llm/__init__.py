"""Operators for training-data pipelines over the tables documents, embeddings, labels and benchmark."""
