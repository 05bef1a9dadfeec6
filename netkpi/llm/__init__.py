"""Operators on text corpora, vectors and web pages."""
