"""Subpackage of folioloom."""
