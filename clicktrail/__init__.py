"""Commerce clickstream analytics as PySpark DataFrame and streaming operators."""
