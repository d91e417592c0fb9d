"""Operators of a training-data pipeline, one module each.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and parameters and returns a DataFrame; ``entries`` holds the thin
``opN_<name>`` queries over the shared tables and their SQL.
"""
