"""Media-catalogue analytics expressed as Spark DataFrame operators."""
