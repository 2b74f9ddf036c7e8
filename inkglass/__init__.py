"""Text audit and cleanup on Spark."""
