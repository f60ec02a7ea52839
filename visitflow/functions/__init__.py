"""Column -> Column building blocks; every one stays inside the JVM."""
