"""Dataset audit, near-duplicate search and model evaluation as Spark DataFrame plans."""
