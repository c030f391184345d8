"""Dataset auditing on Spark: every metric is a lazily planned DataFrame."""
