"""millrace: trajectory-data analytics as Spark DataFrame operators."""
