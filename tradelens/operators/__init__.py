"""Reusable DataFrame operators: dedup, validators, table checks."""
