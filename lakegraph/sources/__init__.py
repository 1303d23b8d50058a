"""Readers: asset files, SQL corpora, dataset folders and catalogs derived from tables."""
