"""Contract clause risk analytics on Spark."""
