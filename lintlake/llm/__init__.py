"""Operators that prepare training texts: filters, scans, deduplication, scoring and packing."""
