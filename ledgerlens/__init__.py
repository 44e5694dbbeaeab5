"""Transaction-history consistency analytics on Spark."""
