"""sievework: content-quality analytics expressed as Spark DataFrame operations."""
