"""The queries, reshapes and batch jobs."""
