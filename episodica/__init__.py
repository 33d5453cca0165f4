"""Episode and corpus analytics on Spark."""
