"""Region-by-day panel analytics expressed as Spark DataFrame operators."""
