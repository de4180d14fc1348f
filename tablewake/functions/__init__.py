"""Column expressions: everything here is a JVM-side expression, no Python UDF."""
