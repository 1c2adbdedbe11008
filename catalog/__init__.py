"""Driver queries and their SQL equivalents."""
