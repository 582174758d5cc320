"""Packrat parsers of the languages of source files."""
