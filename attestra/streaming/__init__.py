"""Event logs in batch and as streams."""
