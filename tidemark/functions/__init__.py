"""Column functions: pure expressions over columns, evaluated in the JVM."""
