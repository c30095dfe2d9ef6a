"""Job-posting analytics on Spark: queries, functions, sources, state and streams."""
