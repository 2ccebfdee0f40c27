"""Data-consistency operators and training-data operators as Spark jobs."""
