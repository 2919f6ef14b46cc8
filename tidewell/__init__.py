"""Point-in-time analytics on Spark: operators, plans, sources and streams."""
