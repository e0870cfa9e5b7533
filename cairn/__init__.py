"""Source-knowledge analytics expressed as Spark DataFrame operators."""
