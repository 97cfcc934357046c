"""Network-trace analytics expressed as Spark DataFrame plans."""
