"""Area risk analytics as Spark DataFrame operators."""
