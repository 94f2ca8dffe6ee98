"""Form and document analytics as lazy Spark DataFrame plans."""
