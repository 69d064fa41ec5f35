"""Sinks: atomic versioned reload of tables, row counts, JSON records."""
