"""Readers of documents, records and manifests, and the record schema."""
