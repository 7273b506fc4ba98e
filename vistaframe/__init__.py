"""Feature-vector analytics and training-data operators, native to Spark."""
