"""Panel and market analytics expressed as Spark DataFrame operators."""
