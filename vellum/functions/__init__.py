"""Column functions: text, enrichment, vectors, answers. All of them stay in the JVM."""
