"""Training-data operators: quality, dedup, search, tokenising, scans, extraction.

Nothing outside this package imports it.
"""
