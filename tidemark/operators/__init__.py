"""Relational operators over mutation logs."""
