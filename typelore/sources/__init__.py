"""Readers, writers and the fixed crawl plan."""
