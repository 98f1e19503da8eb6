"""Source-risk analytics as Spark DataFrame operators."""
