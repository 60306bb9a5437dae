"""Training-data operators: similarity joins, packing, redaction, scoring and formatting.

Nothing outside this subpackage imports it.
"""
