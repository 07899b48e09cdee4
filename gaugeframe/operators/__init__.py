"""Checks on a dataset. Each returns a ``CheckResult``: small metrics, issues, and row flags as a DataFrame."""
