"""Where rasters come from: driver tables, generators, image files."""
