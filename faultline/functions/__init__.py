"""Column-returning building blocks; every one is a native Spark expression."""
