"""Readers that turn files into document tables."""
