"""Column functions: every one returns a Spark ``Column`` and stays inside the JVM."""
