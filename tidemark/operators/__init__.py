"""DataFrame operators; every function maps rows to rows and leaves the physical plan to Spark."""
