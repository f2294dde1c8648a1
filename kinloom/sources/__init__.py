"""Readers and parsers of the text formats, and the writers of the result formats."""
