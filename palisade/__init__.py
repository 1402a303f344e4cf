"""Security-telemetry analytics as Spark DataFrame operators and Structured Streaming jobs."""
