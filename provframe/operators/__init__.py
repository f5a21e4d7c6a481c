"""Operators that need more than one DataFrame call each."""
