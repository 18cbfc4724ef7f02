"""Feature vectors of raw records."""
