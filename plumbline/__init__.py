"""Value domains of tabular data: inference, narrowing, acceptance and rules, as Spark DataFrame operations."""
