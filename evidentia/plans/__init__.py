"""Composed dataflows and the registered queries."""
