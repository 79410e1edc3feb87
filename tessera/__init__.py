"""Contract compliance analytics on Spark."""
