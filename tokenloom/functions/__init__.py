"""Column expressions over text, numbers and times; all stay in the JVM."""
