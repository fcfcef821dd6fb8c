"""Column expressions.  All are built-in JVM expressions; there are no UDFs."""
