"""Flight-delay analytics as plain Spark DataFrame operators."""
