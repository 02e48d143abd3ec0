"""Operators that a plan composes from several DataFrame steps."""
