"""Batch nearest-neighbour search over tables of embeddings, as Spark jobs."""
