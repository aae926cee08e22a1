"""A PySpark engine for cross-sectional signal research."""
