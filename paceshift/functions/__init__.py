"""Column expressions and the few statistical functions Spark SQL lacks."""
