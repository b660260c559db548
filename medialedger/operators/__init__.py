"""DataFrame to DataFrame operators over the catalog and its side tables."""
