"""Early-warning analytics as Spark DataFrame operators."""
