"""Readers and writers of extraction results."""
