"""Column functions. Everything here builds JVM-side Spark expressions."""
