"""Supermarket-flyer price analytics as PySpark DataFrame jobs."""
