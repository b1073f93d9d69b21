"""Column expressions: values of typed and of schemaless rows, coercions, timestamps, patterns. All stay in the JVM."""
