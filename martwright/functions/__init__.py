"""Column functions built from Spark SQL built-ins only."""
