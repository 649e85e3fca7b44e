"""Readers and writers of corpora, graphs and record files."""
