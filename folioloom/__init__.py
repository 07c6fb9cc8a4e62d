"""DataFrame operators and batch jobs for multi-source item catalogs on Spark."""
