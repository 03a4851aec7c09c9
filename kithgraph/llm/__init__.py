"""Operators for corpora of training text: search, scans, filters, duplicates, chat repair, mixing and packing."""
