"""Readers and writers at the edges: plain text, Word and HTML files, glossaries, object store, reports."""
