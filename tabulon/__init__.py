"""A data-analysis engine on Spark: CSV ingest, questions compiled to plans, read-only SQL, sessions and context."""
