"""A PySpark engine for evidence retrieval and text-collection analytics."""
