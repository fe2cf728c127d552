"""quern: hierarchical document retrieval and dataset preparation on Spark."""
