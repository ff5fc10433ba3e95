"""Content-promotion analytics expressed as Spark DataFrame operators."""
