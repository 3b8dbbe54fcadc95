"""Reading, writing and versioning tables."""
