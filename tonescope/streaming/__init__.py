"""The feedback stream."""
