"""Training-data operators: encoding, deduplication, scoring, packing and extraction.

Nothing outside this subpackage imports it; the whole folder can be removed.
"""
