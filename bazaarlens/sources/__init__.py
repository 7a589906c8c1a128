"""Table contracts, loaders and writers."""
