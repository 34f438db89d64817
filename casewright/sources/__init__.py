"""Readers of record files, logs, pages, code and session tables, and the writers of record files."""
