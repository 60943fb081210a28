"""Readers and writers of sequence files and persisted dictionaries."""
