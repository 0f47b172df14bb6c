"""Column functions: per-document signals and helpers, all built from JVM expressions."""
