"""millrace: deterministic analytics and training-data operators written for Spark."""
