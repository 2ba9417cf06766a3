"""Readers and standardised profiles."""
