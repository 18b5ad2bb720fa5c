"""Tessella: multi-institution analytics and training-data operators as Spark jobs."""
