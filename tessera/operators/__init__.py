"""DataFrame operators beyond plain Spark calls."""
