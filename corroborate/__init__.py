"""Evidence fusion and training-data preparation on Spark."""
