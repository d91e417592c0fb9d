"""Raster operators: functions from rasters to rasters or to tables."""
