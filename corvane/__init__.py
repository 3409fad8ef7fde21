"""corvane: document analytics expressed as Spark DataFrame plans."""
