"""Operators on corpora of records: rules, corpus metrics, resolution, sampling."""
