"""A PySpark engine for event templates in semi-structured log text."""
