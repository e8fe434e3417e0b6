"""Column expressions: no shuffles, no actions, everything stays in the JVM."""
