"""Sequence-on-tree analytics and training-data operators on Spark."""
