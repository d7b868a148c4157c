"""factloom: evidence-bound knowledge analytics on Spark."""
