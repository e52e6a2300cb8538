"""The domain tables and feeds, derived from the star-schema test data."""
