"""Operators for preparing training data from a text corpus. Nothing else in the library imports this subpackage."""
