"""Composite queries and the driver's catalogue."""
