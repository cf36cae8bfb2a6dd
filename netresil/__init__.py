"""Road-network resilience analytics as Spark DataFrame operators."""
