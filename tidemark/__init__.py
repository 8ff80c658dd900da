"""tidemark: timed-text evidence analytics, expressed as Spark DataFrame plans."""
