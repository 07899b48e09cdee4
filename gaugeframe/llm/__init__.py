"""Operators for large training-text collections. Nothing outside this subpackage imports it."""
