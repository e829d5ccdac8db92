"""Readers and writers of business tables."""
