"""Readers and writers of recordings and their tables."""
