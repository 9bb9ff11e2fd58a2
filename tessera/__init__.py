"""A PySpark analytics engine: sensor reports in batch and live, matrix products, versioned documents."""
