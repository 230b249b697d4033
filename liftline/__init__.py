"""Liftline: site-and-date forecast analytics as PySpark DataFrame jobs."""
