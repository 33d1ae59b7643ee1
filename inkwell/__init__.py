"""Source-line analytics on Spark."""
