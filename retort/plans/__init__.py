"""Jobs and the registry of queries."""
