"""Column -> Column functions; all of them are built-in JVM expressions."""
