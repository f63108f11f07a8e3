"""Functions that Spark has no built-in form of."""
