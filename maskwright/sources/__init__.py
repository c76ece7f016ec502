"""Readers and writers of blocks of text."""
