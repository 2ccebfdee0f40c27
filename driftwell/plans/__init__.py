"""Declarative repair plans."""
