"""Readers of log folders and writers of results."""
