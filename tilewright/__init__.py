"""Slide datasets on Spark: slide tables, tile grids, mask overlaps, labels and embeddings as DataFrame plans."""
