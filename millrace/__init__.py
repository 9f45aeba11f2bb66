"""millrace: conversation and survey analytics as composable Spark DataFrame operators."""
