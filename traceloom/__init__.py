"""Evidence-backed supply-graph analytics as Spark DataFrame and Structured Streaming jobs."""
