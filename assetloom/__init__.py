"""Asset catalog, reference graph and search jobs for Spark."""
