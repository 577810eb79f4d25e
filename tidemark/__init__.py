"""Snapshot, change-data-capture and training-data operators on Spark."""
