"""Scan configuration, built-in rule layers and the end-to-end scan plan."""
