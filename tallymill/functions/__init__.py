"""Column builders: string and array expressions that stay inside the JVM."""
