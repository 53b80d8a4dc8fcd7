"""Native Column functions."""
