"""Evidence analytics on Spark: sources, functions, operators, plans and streams."""
