"""Readers and writers: text catalogues, event logs, the particle lake, stored tables."""
