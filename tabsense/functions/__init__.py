"""Column-level building blocks (JVM expressions; one Arrow UDF for NFKD)."""
