"""Bulk analytics for vehicle-bus recordings, written as PySpark DataFrame jobs."""
