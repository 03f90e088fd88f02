"""Patient-level cohort analytics as composable Spark DataFrame operators."""
