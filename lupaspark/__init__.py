"""Public-sector data analytics on Spark."""
