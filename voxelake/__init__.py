"""Raster analytics and training-data operators expressed as Spark DataFrame jobs."""
