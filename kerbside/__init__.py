"""Trip analytics expressed as Spark DataFrame transformations."""
