"""Logical plans: silver and gold models, marts, served queries, analyses."""
