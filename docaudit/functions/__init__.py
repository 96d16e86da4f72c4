"""Column-to-Column functions; every one is a plain Spark expression."""
