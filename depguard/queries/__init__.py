"""The queries of __spark_entry__.py for the core, and their SQL."""
