"""Column-level building blocks; all of them compile to native Spark expressions."""
