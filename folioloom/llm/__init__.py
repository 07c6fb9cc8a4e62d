"""Operators for large-scale training-text preparation. Nothing outside this subpackage imports it."""
