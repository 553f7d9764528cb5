"""Early-warning analytics as composable Spark DataFrame operators."""
