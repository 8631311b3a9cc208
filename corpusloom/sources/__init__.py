"""Readers and writers: corpus tables, token-shard files, vocabularies, run metadata."""
