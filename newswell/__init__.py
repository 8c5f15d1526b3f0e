"""Article intelligence as Spark DataFrame transformations."""
