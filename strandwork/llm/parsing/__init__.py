"""Lexing of source files and functions found by matching brackets."""
