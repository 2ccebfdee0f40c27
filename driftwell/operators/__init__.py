"""Operators over tables held by several nodes."""
